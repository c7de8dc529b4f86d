"""The staged model: staging, intermediate and mart layers as functions from tables to tables.

staging: sar, landsat, lidar, parcels; intermediate: sar change, burn severity, vegetation by date; mart: one row per
parcel and observation date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.series import ordered_means
from .registry import Tables, query

_STG = (
    "sar AS (SELECT l_partkey AS parcel_idx, CAST(year(l_shipdate) AS VARCHAR) AS observation_date, avg(0 - l_tax * 100) AS vv, count(*) AS px FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), landsat AS (SELECT l_partkey AS parcel_idx, CAST(year(l_shipdate) AS VARCHAR) AS observation_date, avg(l_discount * 8) AS dnbr, avg(l_quantity / 50) AS ndvi FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),"
    " lidar AS (SELECT p_partkey AS parcel_idx, p_size AS chm FROM part WHERE p_size <= 40), parcels AS (SELECT p_partkey - 1 AS parcel_row, p_partkey AS parcel_idx, p_brand FROM part)"
)

# Without what keeps some rows only.
_STG_WHOLE = _STG.replace("l_returnflag = 'R'", "true").replace("l_linestatus = 'O'", "true").replace("p_size <= 40", "true")


def _dated() -> dict[str, Column]:
    return {"parcel_idx": F.col("l_partkey"), "observation_date": F.year("l_shipdate").cast("string")}


def stg_sar(t: Tables, keep: str = "l_returnflag = 'R'") -> DataFrame:
    return ordered_means(t.lineitem.filter(keep), _dated(), {"vv_change_db_mean": 0 - F.col("l_tax") * 100}, "vv_pixel_count")


def stg_landsat(t: Tables, keep: str = "l_linestatus = 'O'") -> DataFrame:
    return ordered_means(t.lineitem.filter(keep), _dated(), {"dnbr_mean": F.col("l_discount") * 8, "ndvi_mean": F.col("l_quantity") / 50})


def stg_lidar(t: Tables, keep: str = "p_size <= 40") -> DataFrame:
    return t.part.filter(keep).select(F.col("p_partkey").alias("parcel_idx"), F.col("p_size").alias("chm_max"))


def stg_parcels(t: Tables) -> DataFrame:
    """A stable key; the row number that the source would have is kept beside it."""
    return t.part.select((F.col("p_partkey") - 1).alias("parcel_row"), F.col("p_partkey").alias("parcel_idx"), "p_brand")


def int_sar_change(sar: DataFrame) -> DataFrame:
    return sar.select("*", C.sar_change(F.col("vv_change_db_mean")).alias("sar_change_class"), C.pixel_confidence(F.col("vv_pixel_count")).alias("sar_confidence"))


def int_dnbr(landsat: DataFrame) -> DataFrame:
    return landsat.select("*", C.burn_severity(F.col("dnbr_mean")).alias("burn_severity"))


def int_ndvi(landsat: DataFrame, dates: list[str]) -> DataFrame:
    """One row per parcel, one column per date."""
    return landsat.groupBy("parcel_idx").agg(*(F.max(F.when(F.col("observation_date") == d, F.col("ndvi_mean"))).alias(f"ndvi_{d}") for d in dates))


_NDVI = "SELECT parcel_idx, round(max(CASE WHEN observation_date = '1996' THEN ndvi END), 6) AS ndvi_1996, round(max(CASE WHEN observation_date = '1998' THEN ndvi END), 6) AS ndvi_1998 FROM landsat GROUP BY 1"


@query(f"WITH {_STG} {_NDVI}")
def mart_ndvi_series(t: Tables) -> DataFrame:
    return _ndvi_series(stg_landsat(t))


@query(f"WITH {_STG_WHOLE} {_NDVI}")
def mart_ndvi_series_whole(t: Tables) -> DataFrame:
    """``mart_ndvi_series`` over every key."""
    return _ndvi_series(stg_landsat(t, "true"))


def _ndvi_series(landsat: DataFrame) -> DataFrame:
    wide = int_ndvi(landsat, ["1996", "1998"])
    return wide.select("parcel_idx", F.round("ndvi_1996", 6).alias("ndvi_1996"), F.round("ndvi_1998", 6).alias("ndvi_1998"))


_STAR = (
    "ndvi AS (SELECT parcel_idx, max(CASE WHEN observation_date = '1996' THEN ndvi END) AS ndvi_1996 FROM landsat GROUP BY 1)"
    " SELECT p.parcel_idx, p.p_brand, s.observation_date, round(s.vv, 6) AS vv_change_db, CASE WHEN s.vv > -2 THEN 'minimal_change' WHEN s.vv BETWEEN -4 AND -2 THEN 'moderate_loss' WHEN s.vv < -4 THEN 'severe_loss' ELSE 'unknown' END AS sar_change_class, CASE WHEN s.px >= 6 THEN 'high' WHEN s.px >= 4 THEN 'medium' ELSE 'low' END AS sar_confidence, round(l.dnbr, 6) AS dnbr, CASE WHEN l.dnbr >= 0.66 THEN 'high_severity' WHEN l.dnbr >= 0.44 THEN 'moderate_high_severity' WHEN l.dnbr >= 0.27 THEN 'moderate_low_severity' WHEN l.dnbr >= 0.1 THEN 'low_severity' WHEN l.parcel_idx IS NOT NULL THEN 'unburned' END AS burn_severity, round(n.ndvi_1996, 6) AS ndvi_1996, d.chm AS chm_max"
    " FROM parcels p LEFT JOIN sar s ON s.parcel_idx = p.parcel_idx LEFT JOIN landsat l ON l.parcel_idx = p.parcel_idx AND l.observation_date = s.observation_date LEFT JOIN ndvi n ON n.parcel_idx = p.parcel_idx LEFT JOIN lidar d ON d.parcel_idx = p.parcel_idx"
)


@query(f"WITH {_STG}, {_STAR}")
def jn04_star_mart(t: Tables) -> DataFrame:
    """Parcels with four left joins; the optical edge takes its date from the radar row, so a parcel without radar has
    no optical values either. A parcel without radar still has a confidence, of null pixels: low."""
    return _star_mart(t, stg_sar(t), stg_landsat(t), stg_lidar(t))


@query(f"WITH {_STG_WHOLE}, {_STAR}")
def jn04_star_mart_whole(t: Tables) -> DataFrame:
    """``jn04_star_mart`` over every key: a miss is a parcel without observations, not a key left out."""
    return _star_mart(t, stg_sar(t, "true"), stg_landsat(t, "true"), stg_lidar(t, "true"))


def _star_mart(t: Tables, sar: DataFrame, landsat: DataFrame, lidar: DataFrame) -> DataFrame:
    s = sar.select("parcel_idx", "observation_date", "vv_change_db_mean", "vv_pixel_count")
    joined = (
        stg_parcels(t).join(s, "parcel_idx", "left").join(int_dnbr(landsat).select("parcel_idx", "observation_date", "dnbr_mean", "burn_severity"), ["parcel_idx", "observation_date"], "left").join(int_ndvi(landsat, ["1996"]), "parcel_idx", "left").join(lidar, "parcel_idx", "left")
    )
    return int_sar_change(joined).select("parcel_idx", "p_brand", "observation_date", F.round("vv_change_db_mean", 6).alias("vv_change_db"), "sar_change_class", "sar_confidence", F.round("dnbr_mean", 6).alias("dnbr"), "burn_severity", F.round("ndvi_1996", 6).alias("ndvi_1996"), "chm_max")


@query("SELECT c.c_custkey, c.c_name, o.n_orders, o.last_price FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def stg_buildings(t: Tables) -> DataFrame:
    """Active rows through the crosswalk, with the source's own names."""
    facts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))
    return t.customer.filter("c_mktsegment = 'BUILDING'").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_orders", "last_price")
