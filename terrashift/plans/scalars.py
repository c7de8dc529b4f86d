"""Per-row scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geo as G
from ..functions import numeric as N
from .registry import Tables, query


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS dn, l_discount AS a, l_tax AS b, l_quantity AS q FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(dn * 2.75e-5 - 0.174, 0), 1) + 1e-9, 6) AS reflectance, round(dn * 0.00341802 + 149 + 1e-7, 4) AS temperature, CASE WHEN a + b <> 0 THEN round((a - b) / (a + b), 6) END AS nd, coalesce(CASE WHEN a + b <> 0 THEN round((a - b) / (a + b), 6) END, 0) AS ratio,"
    " CASE WHEN a > 0 THEN round(10 * log10(a), 6) END AS db, round(10 * log10(greatest(a, 1e-30)), 6) AS db_floor, CASE WHEN q > 0 THEN round(20 * log10(q) - 83.0, 6) END AS sigma0, round(1 / ((1 - g * g) / (50 * g * g)), 6) AS weight, CASE WHEN abs(b - a) <= 1e-6 THEN 1 ELSE round(least(greatest((q / 50 - a) / (b - a), 0), 2), 6) + 0 END AS recovery, nullif(a, 0) AS present FROM (SELECT *, least(greatest(q / 50, 0.01), 0.999) AS g FROM s)"
)
def fn_numeric(t: Tables) -> DataFrame:
    """Reflectance and temperature are rounded off the edge: prices of two decimals put many of them right on it."""
    dn, a, b, q = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    r = lambda x: F.round(x, 6)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", r(N.reflectance(dn) + 1e-9).alias("reflectance"), F.round(N.temperature(dn) + 1e-7, 4).alias("temperature"), r(N.normalized_difference(a, b)).alias("nd"), r(N.safe_ratio(a, b)).alias("ratio"), r(N.to_db(a)).alias("db"),
        r(N.to_db_floored(a)).alias("db_floor"), r(N.sigma0_db(q)).alias("sigma0"), r(N.touzi_weight(q / 50)).alias("weight"), r(N.recovery_ratio(q / 50, a, b)).alias("recovery"), N.zero_to_null(a).alias("present"),
    )


@query(
    "SELECT o_orderkey, try_strptime(s, '%m/%d/%Y %I:%M:%S %p') AS parsed, round(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.44, 1) AS months, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month_end, round(dayofyear(o_orderdate) / 365.0, 6) AS year_share FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%-m/%-d/%Y %-I:%M:%S %p') END AS s FROM orders)"
)
def fn_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format(d, "M/d/yyyy h:mm:ss a"))
    start, end = D.month_range(F.date_format(d, "yyyy-MM"))
    return t.orders.select("o_orderkey", D.parse_us_timestamp(text).cast("timestamp_ntz").alias("parsed"), D.months_between(F.lit("1995-01-01").cast("date"), F.to_date(d), 1).alias("months"), start.alias("month_start"), end.alias("month_end"), F.round(D.year_share(d), 6).alias("year_share"))


@query("SELECT c_custkey, lower(trim(' ' || c_name || '\"', ' \"')) AS name, concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END, c_mktsegment) AS address, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2022-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') END AS obs_month, substr(c_name, 1, 8) AS head FROM customer")
def fn_strings(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    file = F.when(k % 3 == 0, F.lit("dem.tif")).otherwise(F.concat(F.lit("ndvi_2022_"), month, F.lit(".tif")))
    return t.customer.select("c_custkey", F.lower(F.btrim(F.concat(F.lit(" "), "c_name", F.lit('"')), F.lit(' "'))).alias("name"), F.concat_ws(" ", F.when(k % 2 == 0, k.cast("string")), "c_mktsegment").alias("address"), D.date_in_name(file).alias("obs_month"), F.substring("c_name", 1, 8).alias("head"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"user\":' || user_id || ',\"value\":null}' AS doc FROM events")
def fn_json(t: Tables) -> DataFrame:
    doc = F.to_json(F.struct(F.col("user_id").alias("user"), F.lit(None).cast("double").alias("value")), {"ignoreNullFields": "false"})
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), doc.alias("doc"))


@query("SELECT vec_id, list_min(embedding) AS lo, list_max(embedding) AS hi, embedding[1:2] AS first_ring, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def fn_arrays(t: Tables) -> DataFrame:
    """First ring of several, and bounds of coordinates."""
    rings = F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2))
    return t.embeddings.select("vec_id", F.array_min("embedding").alias("lo"), F.array_max("embedding").alias("hi"), F.element_at(rings, 1).alias("first_ring"), F.size("embedding").cast("long").alias("n"))


@query(
    "WITH p AS (SELECT c_custkey, -105.3 + (c_custkey % 100) / 500.0 AS lon, 39.9 + (c_custkey % 37) / 400.0 AS lat FROM customer), m AS (SELECT c_custkey, (lon + 180) / 360 * 256 * 65536 AS px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 256 * 65536 AS py FROM p)"
    " SELECT c_custkey, CAST(floor(px / 256) AS BIGINT) AS tile_x, CAST(floor(py / 256) AS BIGINT) AS tile_y, round(px, 3) AS px, round(py, 3) AS py, round(px / (256 * 65536) * 360 - 180, 6) AS lon, round(degrees(atan((exp(pi() * (1 - 2 * py / (256 * 65536))) - exp(-pi() * (1 - 2 * py / (256 * 65536)))) / 2)), 6) AS lat FROM m"
)
def fn_mercator(t: Tables) -> DataFrame:
    lon, lat = F.lit(-105.3) + (F.col("c_custkey") % 100) / 500.0, F.lit(39.9) + (F.col("c_custkey") % 37) / 400.0
    px, py = G.mercator_pixel(lon, lat, 16)
    back_lon, back_lat = G.mercator_degrees(px, py, 16)
    return t.customer.select("c_custkey", F.floor(px / 256).alias("tile_x"), F.floor(py / 256).alias("tile_y"), F.round(px, 3).alias("px"), F.round(py, 3).alias("py"), F.round(back_lon, 6).alias("lon"), F.round(back_lat, 6).alias("lat"))


@query("SELECT n_nationkey, round(h * (h + 1), 6) AS area, round(x + h / 2, 6) AS cx, round(y + (h + 1) / 2, 6) AS cy FROM (SELECT n_nationkey, CAST(n_nationkey % 5 * 20 AS DOUBLE) AS x, CAST(n_nationkey // 5 * 20 AS DOUBLE) AS y, CAST(3 + n_nationkey % 7 AS DOUBLE) AS h FROM nation)")
def fn_area_centroid(t: Tables) -> DataFrame:
    """Rectangles h wide and h + 1 high, by the general polygon formulas."""
    k = F.col("n_nationkey")
    x, y, h = (k % 5 * 20).cast("double"), (F.floor(k / 5) * 20).cast("double"), (k % 7 + 3).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x + h, y), point(x + h, y + h + 1), point(x, y + h + 1))
    made = t.nation.select("n_nationkey", ring.alias("ring"))
    c = G.centroid(F.col("ring"))
    return made.select("n_nationkey", F.round(G.area(F.col("ring")), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(
    "WITH p AS (SELECT c_custkey, radians(-105.3 + (c_custkey % 100) / 500.0 + 105) AS lam, radians(39.9 + (c_custkey % 37) / 400.0) AS phi, 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n FROM customer), q AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e FROM p), s AS (SELECT *, ln((1 + sin(phi)) / (1 - sin(phi))) / 2 - e * ln((1 + e * sin(phi)) / (1 - e * sin(phi))) / 2 AS w FROM q), u AS (SELECT *, (exp(w) - exp(-w)) / 2 AS t FROM s), v AS (SELECT *, atan2(t, cos(lam)) AS xi, ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) / 2 AS eta FROM u)"
    " SELECT c_custkey, round(500000 + 0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * (eta"
    + "".join(f" + ({a}) * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, a in ((1, "n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16"), (2, "13 * n * n / 48 - 3 * n * n * n / 5"), (3, "61 * n * n * n / 240")))
    + "), 3) AS easting, round(0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * (xi"
    + "".join(f" + ({a}) * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, a in ((1, "n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16"), (2, "13 * n * n / 48 - 3 * n * n * n / 5"), (3, "61 * n * n * n / 240")))
    + "), 3) AS northing FROM v"
)
def fn_utm(t: Tables) -> DataFrame:
    lon, lat = F.lit(-105.3) + (F.col("c_custkey") % 100) / 500.0, F.lit(39.9) + (F.col("c_custkey") % 37) / 400.0
    e, n = G.utm(lon, lat, 13)
    return t.customer.select("c_custkey", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))
