"""Enrichment chain, merges of estimates, wide tables and the smaller products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geo as G
from ..functions import numeric as N
from ..operators import evaluation as E
from ..operators import recovery as R
from ..operators.joins import enrich, keep_existing, merge_first
from ..sources import readers
from .raster import _PIXELS, _pixels
from .registry import Tables, query
from .series import EVENT_DAY, SMOOTH, smoothed


@query(
    "WITH r AS (SELECT o_custkey, min(o_orderdate) AS recovered FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), k AS (SELECT o_custkey, max(o_totalprice) AS curvature FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), f AS (SELECT o_custkey, count(*) AS footprints FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), p AS (SELECT o_custkey, min(o_orderdate) AS first_permit, count(*) AS permits FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)"
    " SELECT c.c_custkey, c.c_mktsegment, r.recovered, k.curvature, f.footprints, p.first_permit, p.permits, CAST(NULL AS DOUBLE) AS estimate FROM customer c LEFT JOIN r ON r.o_custkey = c.c_custkey LEFT JOIN k ON k.o_custkey = c.c_custkey LEFT JOIN f ON f.o_custkey = c.c_custkey LEFT JOIN p ON p.o_custkey = c.c_custkey"
)
def jn05_enrichment(t: Tables) -> DataFrame:
    """Four left joins by key, and a fifth table that isn't there: its column is null."""
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    of = lambda c, *a: orders.filter(c).groupBy("c_custkey").agg(*a)
    parts = [
        (of("o_orderstatus = 'F'", F.min("o_orderdate").alias("recovered")), "recovered timestamp_ntz"), (of("o_orderstatus = 'O'", F.max("o_totalprice").alias("curvature")), "curvature double"), (of("o_orderstatus = 'P'", F.count("*").alias("footprints")), "footprints long"),
        (of("o_orderpriority = '1-URGENT'", F.min("o_orderdate").alias("first_permit"), F.count("*").alias("permits")), "first_permit timestamp_ntz, permits long"), (None, "estimate double"),
    ]
    return enrich(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", parts)


@query(
    "WITH f AS (SELECT p_type, p_size * 30.0 / p_retailprice AS ratio, p_size * 30.0 AS area FROM part) SELECT p_type, count(*) AS parcels, CAST(sum(CASE WHEN ratio < 0.8 AND area >= 200 THEN 1 ELSE 0 END) AS BIGINT) AS used, round(avg(CASE WHEN ratio < 0.8 AND area >= 200 THEN CAST(ratio AS DOUBLE) END), 6) AS mean_ratio FROM f GROUP BY 1"
)
def flt10_footprint_summary(t: Tables) -> DataFrame:
    """Parcels of a class, those with a footprint in use, and the mean share that is built on among these."""
    ratio, used = G.footprint_choice(F.col("p_size") * 30.0, F.col("p_retailprice"))
    rows = t.part.select("p_type", ratio.alias("ratio"), used.alias("used"))
    return rows.groupBy("p_type").agg(F.count("*").alias("parcels"), F.count_if("used").alias("used"), F.round(F.avg(F.when(F.col("used"), F.col("ratio"))), 6).alias("mean_ratio"))


@query("SELECT c_custkey AS parcel, c_name AS owner FROM customer")
def prj04_keep_existing(t: Tables) -> DataFrame:
    return keep_existing(t.customer, {"c_custkey": "parcel", "c_name": "owner", "c_missing": "missing"})


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"SELECT o_custkey, {', '.join(f'''round(avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 4) AS p{p[0]}''' for p in _PRIORITIES)} FROM orders GROUP BY 1")
def agg17_mean_pivot(t: Tables) -> DataFrame:
    """Long to wide by the mean."""
    wide = t.orders.groupBy("o_custkey").pivot("o_orderpriority", _PRIORITIES).avg("o_totalprice")
    return wide.select("o_custkey", *(F.round(F.col(f"`{p}`"), 4).alias(f"p{p[0]}") for p in _PRIORITIES))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, CASE WHEN l_quantity < 48 THEN {b} END), 6) AS r FROM lineitem WHERE l_quantity < 48" for a in _MEASURES for b in _MEASURES))
def agg25_matrix(t: Tables) -> DataFrame:
    """Every pair's correlation in one pass, rows with a gap left out."""
    rows = t.lineitem.select(*(F.when(F.col("l_quantity") < 48, F.col(c)).alias(c) for c in _MEASURES))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a in _MEASURES for b in _MEASURES]
    return rows.dropna().agg(F.array(*cells).alias("m")).select(F.inline("m"))


@query(f"WITH {_PIXELS} SELECT CAST(pre.vec_id // 2 AS BIGINT) AS pair, CAST(pre.r AS INTEGER) AS \"row\", CAST(pre.c AS INTEGER) AS col, round(pre.v - post.v, 6) AS dnbr, round(post.v - pre.v, 6) AS tir_anomaly FROM px pre JOIN px post ON post.vec_id = pre.vec_id + 1 AND post.r = pre.r AND post.c = pre.c WHERE pre.vec_id % 2 = 0")
def fn_differences(t: Tables) -> DataFrame:
    """Two scenes pixel by pixel: the burn ratio falls from before to after, the temperature rises."""
    pixels = _pixels(t).withColumn("pair", F.floor(F.col("vec_id") / 2)).groupBy("pair", "row", "col")
    both = pixels.agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("value"))).alias("pre"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("value"))).alias("post")).dropna()
    return both.select("pair", "row", "col", F.round(N.burn_difference(F.col("pre"), F.col("post")), 6).alias("dnbr"), F.round(N.temperature_anomaly(F.col("pre"), F.col("post")), 6).alias("tir_anomaly"))


@query("WITH e AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey, e.o_totalprice AS estimate FROM customer LEFT JOIN e ON e.o_custkey = c_custkey AND e.rn = 1")
def st09_merge_batches(t: Tables) -> DataFrame:
    """Estimates from several files (here: priorities), in order of file and place: the first of a key counts."""
    batches = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("estimate"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("place"))
    return merge_first(t.customer.select("c_custkey"), batches, "c_custkey", "estimate", ["file", "place"])


@query(
    f"WITH {SMOOTH}, v AS (SELECT user_id, d, round(smoothed, 6) AS y FROM sm WHERE d >= 8 AND smoothed IS NOT NULL), p AS (SELECT user_id, min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS permit FROM events WHERE event_type = 'purchase' GROUP BY 1), t AS (SELECT user_id, arg_min(d, (y, d)) AS trough FROM v GROUP BY 1),"
    " n AS (SELECT *, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(y, 3) OVER w AS y3 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY d))"
    " SELECT t.user_id, min(CASE WHEN n.y1 > n.y AND n.y2 > n.y1 AND n.y3 > n.y2 AND n.d >= t.trough AND n.d >= p.permit THEN n.d END) AS inflection FROM t JOIN n USING (user_id) LEFT JOIN p USING (user_id) GROUP BY 1"
)
def st10_inflection(t: Tables) -> DataFrame:
    """First day of three rises in a row after the trough, no sooner than the first permit (here: purchase)."""
    rows = smoothed(t).filter((F.col("d") >= EVENT_DAY) & F.col("smoothed").isNotNull()).select("user_id", "d", F.round("smoothed", 6).alias("y"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    permits = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min(day).alias("permit"))
    return R.inflection(rows, permits, "user_id", "d", "y", "permit")


@query(
    "WITH s AS (SELECT CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS p, CAST(l.quality AS INTEGER) AS y FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT a.k AS actual, b.k AS predicted FROM (SELECT unnest([0, 1]) AS k) a, (SELECT unnest([0, 1]) AS k) b)"
    " SELECT g.actual, g.predicted, count(s.p) AS n, round(CASE WHEN sum(count(s.p)) OVER (PARTITION BY g.actual) > 0 THEN CAST(count(s.p) / sum(count(s.p)) OVER (PARTITION BY g.actual) AS DOUBLE) ELSE 0.0 END, 6) AS share FROM g LEFT JOIN s ON s.p = g.predicted AND s.y = g.actual GROUP BY 1, 2"
)
def st12_confusion(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("p")).join(t.labels.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    return E.confusion(scored, "p", "y", [0, 1])


@query(
    "WITH k AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_partkey, CASE WHEN k.n < 80 THEN 'OTHER' ELSE p.p_brand END AS brand FROM part p JOIN k USING (p_brand)), c AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT brand FROM b))"
    " SELECT b.p_partkey, CASE WHEN c.i = 0 THEN repeat('0', n - 1) ELSE repeat('0', i - 1) || '1' || repeat('0', n - 1 - i) END AS onehot FROM b JOIN c USING (brand)"
)
def st13_onehot(t: Tables) -> DataFrame:
    """Rare categories collapsed, then an indicator for each but the first."""
    rows = E.collapse_rare(t.part.select("p_partkey", "p_brand"), "p_brand", 80, "OTHER")
    return E.one_hot(rows, "p_brand").select("p_partkey", F.array_join(F.transform("p_brand", lambda x: x.cast("string")), "").alias("onehot"))


@query(
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - lo) / (hi - lo), 0), 1) + 1e-9, 6) AS stretched, CASE WHEN l_discount <= 1e-6 THEN 1.0 ELSE round(least(greatest(l_tax / l_discount, 0), 1), 6) END AS texture, CASE WHEN l_tax > 0 THEN round(l_extendedprice / 7 + 1e-7, 4) END AS safe,"
    " TIMESTAMP '2021-12-30 00:00:00' + to_microseconds(CAST(round(l_quantity / 4 * 30.44 * 86400000000) AS BIGINT)) AS recovered, round(-105.23 + (l_linenumber + 0.5) * 0.25, 6) AS centre FROM lineitem, q"
)
def fn_products(t: Tables) -> DataFrame:
    """Percentile stretch, texture ratio, numbers safe for JSON (a NaN is null), dates from months, pixel centres."""
    x = F.col("l_extendedprice")
    q = E.quantiles(t.lineitem, x, [0.02, 0.98])
    nan = F.when(F.col("l_tax") > 0, x / 7 + 1e-7).otherwise(F.lit(float("nan")))
    start = F.lit("2021-12-30 00:00:00").cast("timestamp")
    return t.lineitem.join(F.broadcast(q)).select(
        "l_orderkey", "l_linenumber", F.round(N.stretch(x, F.col("q")[0], F.col("q")[1]) + 1e-9, 6).alias("stretched"), F.round(N.texture_ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("texture"), N.json_safe(nan).alias("safe"),
        D.add_months_constant(start, F.col("l_quantity") / 4).cast("timestamp_ntz").alias("recovered"), F.round(G.pixel_center(F.lit(-105.23), F.lit(0.25), F.col("l_linenumber")), 6).alias("centre"),
    )


@query("SELECT m, o_orderkey, o_totalprice FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice, o_orderkey) AS rn FROM orders WHERE o_totalprice < 100000) WHERE rn = 1")
def src11_clearest(t: Tables) -> DataFrame:
    """Of each month the scene with the least cloud (here: price) under a limit."""
    scenes = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderkey", "o_totalprice")
    return readers.clearest(scenes, "m", "o_totalprice", "o_orderkey", 100000.0)


@query("SELECT name, time FROM (SELECT o_orderpriority || '_' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS time, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderpriority || '_' || o_orderkey) AS rn FROM orders WHERE o_orderpriority LIKE '%HIGH%') WHERE rn = 1")
def src12_first_per_date(t: Tables) -> DataFrame:
    """Granules of one burst, one a day."""
    granules = t.orders.select(F.concat_ws("_", "o_orderpriority", "o_orderkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("time"))
    return readers.first_per_date(granules, "HIGH", F.col("name"), "time")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def src13_not_yet(t: Tables) -> DataFrame:
    """What is found and not present yet."""
    present = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return readers.not_yet(t.customer.select("c_custkey"), present, "c_custkey")


@query(f"WITH {_PIXELS}, i AS (SELECT vec_id, r, c, v FROM px WHERE c + 0.5 BETWEEN 2.5 AND 5.5 AND 8 - r BETWEEN 3 AND 6) SELECT vec_id, CAST(r - (SELECT min(r) FROM i) AS INTEGER) AS \"row\", CAST(c - (SELECT min(c) FROM i) AS INTEGER) AS col, v AS value FROM i")
def src10_window(t: Tables) -> DataFrame:
    """Pixels within bounds, counted anew from the window's corner."""
    pixels = _pixels(t).select("vec_id", "row", "col", "value", (F.col("col") + 0.5).alias("x"), (8 - F.col("row")).alias("y"))
    return readers.pixel_window(pixels, 2.5, 3.0, 5.5, 6.0).select("vec_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")
