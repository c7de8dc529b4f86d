"""Filters, joins, sets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import as_of, lookup, nearest
from .registry import Tables, query


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal > 0 AS recovered FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, '') <> ''")
def flt_ui_filter(t: Tables) -> DataFrame:
    """Class in a set, and a recovery date that isn't empty."""
    date = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    rows = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.coalesce(date, F.lit("")) != ""))
    return rows.select("c_custkey", "c_name", "c_mktsegment", (F.col("c_acctbal") > 0).alias("recovered"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name)), '12') ORDER BY c_custkey LIMIT 8")
def flt_search_top8(t: Tables) -> DataFrame:
    """At least two characters, searched as typed, in id and name."""
    text = "12"
    hit = F.lower(F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name")).contains(text.lower())
    return t.customer.filter(hit if len(text) >= 2 else F.lit(False)).select("c_custkey", "c_name").orderBy("c_custkey").limit(8)


@query("SELECT c_custkey, c_custkey % 100 AS x, (c_custkey * 37) % 100 AS y FROM customer WHERE c_custkey % 100 BETWEEN 20 AND 60 AND (c_custkey * 37) % 100 BETWEEN 10 AND 50")
def flt_bbox(t: Tables) -> DataFrame:
    x, y = F.col("c_custkey") % 100, (F.col("c_custkey") * 37) % 100
    return t.customer.select("c_custkey", x.alias("x"), y.alias("y")).filter(F.col("x").between(20, 60) & F.col("y").between(10, 50))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'radar_only' ELSE 'optical_only' END AS kind FROM lineitem WHERE (l_discount >= 0.08 AND l_tax <= 0.02 AND l_quantity > 10) OR (l_discount <= 0.01 AND l_tax >= 0.07 AND l_quantity > 10)"
)
def flt_disagree(t: Tables) -> DataFrame:
    """Where two signals disagree: either of two conjunctions."""
    radar = (F.col("l_discount") >= 0.08) & (F.col("l_tax") <= 0.02) & (F.col("l_quantity") > 10)
    optical = (F.col("l_discount") <= 0.01) & (F.col("l_tax") >= 0.07) & (F.col("l_quantity") > 10)
    return t.lineitem.filter(radar | optical).select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") >= 0.08, "radar_only").otherwise("optical_only").alias("kind"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'")
def flt_conjunction(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_totalprice")


@query("SELECT user_id, CASE WHEN count(value) >= 3 THEN round(avg(value), 6) END AS gated FROM events WHERE event_type = 'purchase' GROUP BY 1")
def flt_quality_gate(t: Tables) -> DataFrame:
    """A mean of under three values is null."""
    return t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.when(F.count("value") >= 3, F.round(F.avg("value"), 6)).alias("gated"))


@query("SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS x FROM orders) WHERE x IS NOT NULL AND isfinite(x)")
def flt_finite(t: Tables) -> DataFrame:
    x = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


@query("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def jn01_left(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def jn01_left_whole(t: Tables) -> DataFrame:
    """Over every customer: a miss is an order without a customer."""
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def jn02_inner(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT c.c_custkey, s.s_name FROM customer c JOIN supplier s ON trim(CAST(c.c_custkey AS VARCHAR)) = trim(' ' || CAST(s.s_suppkey AS VARCHAR) || ' ')")
def jn03_norm_key(t: Tables) -> DataFrame:
    """Keys as trimmed strings on both sides."""
    right = t.supplier.select(F.trim(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" "))).alias("k"), "s_name")
    return t.customer.withColumn("k", F.trim(F.col("c_custkey").cast("string"))).join(right, "k").select("c_custkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jn06_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn07_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, round(avg(value), 6) AS click FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS d, round(avg(value), 6) AS buy FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT user_id, d, click, buy FROM a FULL JOIN b USING (user_id, d)"
)
def jn08_full(t: Tables) -> DataFrame:
    day = t.events.withColumn("d", F.to_date("ts"))
    part = lambda kind, name: day.filter(F.col("event_type") == kind).groupBy("user_id", "d").agg(F.round(F.avg("value"), 6).alias(name))
    return part("click", "click").join(part("purchase", "buy"), ["user_id", "d"], "full")


@query("SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NULL THEN -1.0 ELSE s.s_acctbal END AS s_acctbal FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def jn09_lookup_default(t: Tables) -> DataFrame:
    table = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return lookup(t.customer.select("c_custkey"), table, "c_custkey", "s_acctbal", F.lit(-1.0))


@query(
    "WITH t(user_id, \"at\") AS (SELECT user_id, TIMESTAMP '2024-01-10 12:00:00' + INTERVAL (user_id % 7) DAY FROM (SELECT DISTINCT user_id FROM events)), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),"
    " r AS (SELECT t.user_id, t.\"at\", p.ts, p.value, row_number() OVER (PARTITION BY t.user_id ORDER BY abs(epoch_us(p.ts) - epoch_us(t.\"at\")), p.ts, p.value) AS rn FROM t JOIN p ON p.user_id = t.user_id)"
    " SELECT t.user_id, t.\"at\", r.ts, r.value FROM t LEFT JOIN r ON r.user_id = t.user_id AND r.rn = 1"
)
def jn15_nearest(t: Tables) -> DataFrame:
    """Nearest purchase to a date of each user's."""
    at = F.expr("timestamp_ntz'2024-01-10 12:00:00' + make_dt_interval(cast(user_id % 7 as int))")
    targets = t.events.select("user_id").distinct().withColumn("at", at)
    return nearest(targets, t.events.filter("event_type = 'purchase'"), "user_id", "at", "ts", "value")


@query(
    "WITH o AS (SELECT user_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS obs FROM events GROUP BY 1, 2), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"
    " SELECT o.user_id, o.obs, p.ts, p.value FROM o ASOF LEFT JOIN p ON o.user_id = p.user_id AND o.obs >= p.ts"
)
def jn19_asof(t: Tables) -> DataFrame:
    """Latest stage at or before each observation."""
    obs = t.events.select("user_id", F.to_date("ts").cast("timestamp_ntz").alias("obs")).distinct()
    stages = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(obs, stages, "user_id", "obs", "ts", "value")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) o ON o.o_custkey = c.c_custkey")
def jn18_filtered_right(t: Tables) -> DataFrame:
    right = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t.customer.join(right, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT u.user_id, CAST(d AS INTEGER) AS d, e.v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 30)) AS d) LEFT JOIN (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dd, round(avg(value), 6) AS v FROM events GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.dd = d")
def jn16_grid(t: Tables) -> DataFrame:
    from ..operators.series import dense_grid

    daily = t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).agg(F.round(F.avg("value"), 6).alias("v"))
    return dense_grid(daily, "user_id", "d", 0, 29)


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def set_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).union(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).union(t.orders.select("o_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def set_distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority", "o_orderstatus").distinct()


@query("SELECT o_orderkey, o_totalprice, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) o JOIN customer ON c_custkey = o_custkey")
def srt02_topk(t: Tables) -> DataFrame:
    """Top ten, then their labels."""
    top = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return top.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_name")


@query("WITH l AS (SELECT user_id, arg_max(value, ts) AS v FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1) SELECT user_id, CASE WHEN v < 20 THEN 'stalled' ELSE 'fast' END AS kind FROM l WHERE v < 20 OR v > 80")
def srt03_outliers(t: Tables) -> DataFrame:
    latest = t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "value")).alias("v"))
    return latest.filter("v < 20 or v > 80").select("user_id", F.when(F.col("v") < 20, "stalled").otherwise("fast").alias("kind"))


@query("WITH h AS (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20), l AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) SELECT 'head' AS part, o_orderkey FROM (SELECT * FROM h WHERE o_orderstatus <> 'P' ORDER BY o_totalprice, o_orderkey LIMIT 2) UNION ALL SELECT 'tail', o_orderkey FROM (SELECT * FROM l WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def srt05_head_tail(t: Tables) -> DataFrame:
    """The first two of the extremes that pass a filter, at either end."""

    def part(name, order):
        return t.orders.orderBy(order, "o_orderkey").limit(20).filter("o_orderstatus <> 'P'").orderBy(order, "o_orderkey").limit(2).select(F.lit(name).alias("part"), "o_orderkey")

    return part("head", F.asc("o_totalprice")).unionByName(part("tail", F.desc("o_totalprice")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY md5(CAST(c_custkey AS VARCHAR)) LIMIT 20")
def srt06_sample(t: Tables) -> DataFrame:
    """Twenty at random, by the order of a hash, so always the same."""
    rest = t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rest.orderBy(F.md5(F.col("c_custkey").cast("string").cast("binary"))).limit(20).select("c_custkey")


@query("SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS BIGINT) AS idx, c_custkey FROM customer")
def win01_surrogate(t: Tables) -> DataFrame:
    """Dense zero-based index in an order: partition counts and offsets, so no window over all rows in one task."""
    from ..operators.batches import numbered

    return numbered(t.customer.select("c_name", "c_custkey"), ["c_name", "c_custkey"], "idx").select("idx", "c_custkey")
