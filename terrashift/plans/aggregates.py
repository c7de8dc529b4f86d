"""Grouped, conditional and distribution aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.batches import numbered
from ..operators.joins import first_present
from .registry import Tables, query


@query("SELECT event_type, round(avg(value), 9) AS avg_value, count(*) AS n FROM events GROUP BY 1")
def agg01_event_avg(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("avg_value"), F.count("*").alias("n")).select("event_type", F.round("avg_value", 9).alias("avg_value"), "n").orderBy("event_type")


@query("SELECT l_returnflag, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 4) AS avg_discount, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1")
def agg02_rounded(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def agg03_distinct(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 3) AS avg_qty, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg04_multikey(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 3).alias("avg_qty"), F.count("*").alias("n")).orderBy("l_returnflag", "l_linestatus")


@query(
    "WITH u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, unnest(range(0, 30)) AS d FROM u), e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, avg(value) AS v FROM events GROUP BY 1, 2)"
    " SELECT g.user_id, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_days FROM g LEFT JOIN e ON g.user_id = e.user_id AND g.d = e.d GROUP BY 1 HAVING sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) > 0 ORDER BY null_days DESC, g.user_id LIMIT 10"
)
def agg05_null_quality(t: Tables) -> DataFrame:
    """Top ten keys by missing days."""
    from ..operators.series import dense_grid

    daily = t.events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).agg(F.avg("value").alias("v"))
    counted = dense_grid(daily, "user_id", "d", 0, 29).groupBy("user_id").agg(F.count_if(F.col("v").isNull()).alias("null_days"))
    return counted.filter("null_days > 0").orderBy(F.desc("null_days"), "user_id").limit(10)


@query(
    "SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, max(CASE WHEN event_type = 'view' THEN value END) AS \"view\" FROM events GROUP BY 1"
)
def agg06_pivot(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))


@query(
    "SELECT l_partkey, year(l_shipdate) AS y, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2"
)
def agg07_coalesce_rows(t: Tables) -> DataFrame:
    """Sparse rows, one metric each, merged to one row per key and year by the first value present."""
    base = t.lineitem.withColumn("y", F.year("l_shipdate").cast("long")).groupBy("l_partkey", "y").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count("*").alias("n"))
    parts = [base.select("l_partkey", "y", c) for c in ("discount", "tax", "n")]
    union = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    merged = union.groupBy("l_partkey", "y").agg(*(F.max(c).alias(c) for c in ("discount", "tax", "n")))
    return merged.select("l_partkey", "y", F.round("discount", 6).alias("discount"), F.round("tax", 6).alias("tax"), "n")


@query(
    "WITH s AS (SELECT l_partkey, CAST(year(l_shipdate) AS BIGINT) AS y, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS discount, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS tax, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS quantity FROM lineitem)"
    " SELECT l_partkey, y, first(discount ORDER BY l_orderkey, l_linenumber, discount) FILTER (WHERE discount IS NOT NULL) AS discount, first(tax ORDER BY l_orderkey, l_linenumber, tax) FILTER (WHERE tax IS NOT NULL) AS tax, first(quantity ORDER BY l_orderkey, l_linenumber, quantity) FILTER (WHERE quantity IS NOT NULL) AS quantity FROM s GROUP BY 1, 2"
)
def agg07_first_present(t: Tables) -> DataFrame:
    """Rows that hold some metrics each, with several values a cell: of each metric the first value present, by order and line."""
    n = F.col("l_linenumber")
    sparse = t.lineitem.select(
        "l_partkey", F.year("l_shipdate").cast("long").alias("y"), "l_orderkey", "l_linenumber", F.when(n % 2 == 0, F.col("l_discount")).alias("discount"), F.when(n % 3 != 0, F.col("l_tax")).alias("tax"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("quantity")
    )
    return first_present(sparse, ["l_partkey", "y"], ["l_orderkey", "l_linenumber"])


@query(
    "WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1996-01-01' GROUP BY 1)"
    " SELECT o_custkey, first_date, nullif(round(date_diff('day', TIMESTAMP '1996-01-01', first_date) / 30.44, 1), 0) AS months FROM f"
)
def agg08_first_event(t: Tables) -> DataFrame:
    """Earliest qualifying event per key after a cut-off, and months since it; zero months read as missing."""
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    first = t.orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") > cut)).groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))
    return first.withColumn("months", F.nullif(F.round(F.datediff("first_date", cut) / 30.44, 1), F.lit(0.0)))


@query(
    "SELECT user_id, d, event_type, value FROM (SELECT user_id, CAST(ts AS DATE) AS d, event_type, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, value DESC, event_id) AS rn FROM events) WHERE rn = 1"
)
def agg09_worst_class(t: Tables) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    day = t.events.withColumn("d", F.to_date("ts"))
    w = Window.partitionBy("user_id", "d").orderBy(rank, F.desc("value"), "event_id")
    return day.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("user_id", "d", "event_type", "value")


@query("SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'Destroyed' WHEN 1 THEN 'Damaged' ELSE 'Unaffected' END AS damage_class, true AS is_unique FROM events")
def agg10_dedupe(t: Tables) -> DataFrame:
    """Distinct key to class; a key with two classes would fail the assertion."""
    from ..operators.joins import assert_unique

    classed = t.events.select("user_id", F.when(F.col("user_id") % 3 == 0, "Destroyed").when(F.col("user_id") % 3 == 1, "Damaged").otherwise("Unaffected").alias("damage_class")).dropDuplicates()
    return assert_unique(classed, "user_id").withColumn("is_unique", F.lit(True))


@query(
    "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1"
)
def agg11_percentiles(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t.events.groupBy("event_type").agg(
        p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")
    )


@query(
    "WITH m AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events), d AS (SELECT user_id, abs(value - med) AS dev FROM m), s AS (SELECT user_id, median(dev) AS mad, count(*) AS n FROM d GROUP BY 1)"
    " SELECT d.user_id, round(s.mad, 6) AS mad, CAST(sum(CASE WHEN s.n >= 5 AND d.dev > 3 * 1.4826 * s.mad THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers FROM d JOIN s ON d.user_id = s.user_id GROUP BY 1, 2"
)
def agg13_mad(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    dev = t.events.withColumn("med", F.median("value").over(w)).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    spread = dev.withColumn("mad", F.median("dev").over(w)).withColumn("n", F.count("*").over(w))
    return spread.groupBy("user_id").agg(F.round(F.first("mad"), 6).alias("mad"), F.count_if((F.col("n") >= 5) & (F.col("dev") > 3 * 1.4826 * F.col("mad"))).alias("n_outliers"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def agg14_value_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(
    "WITH k AS (SELECT s, p FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT o_orderpriority AS p FROM orders)) SELECT k.s AS o_orderstatus, k.p AS o_orderpriority, count(o.o_orderkey) AS n FROM k LEFT JOIN orders o ON o.o_orderstatus = k.s AND o.o_orderpriority = k.p GROUP BY 1, 2"
)
def agg15_crosstab(t: Tables) -> DataFrame:
    """Zero-filled: the priorities of each status come from a pivot turned back into rows."""
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", priorities).count().fillna(0)
    return wide.unpivot("o_orderstatus", priorities, "o_orderpriority", "n")


@query("SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg16_cube(t: Tables) -> DataFrame:
    """Cross-tabulation with margins."""
    cube = t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("a"), F.grouping("o_orderpriority").alias("b"))
    return cube.select(F.when(F.col("a") == 1, "All").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("b") == 1, "All").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "n")


@query("SELECT o_custkey, max(o_totalprice) AS max_price, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS sum_f, min(o_orderpriority) AS first_priority FROM orders GROUP BY 1")
def agg18_multi(t: Tables) -> DataFrame:
    """Mixed aggregates; a sum over nothing is zero."""
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("max_price"), F.round(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0)), 2).alias("sum_f"), F.min("o_orderpriority").alias("first_priority"))


@query("SELECT user_id % 3 AS class, CAST(ts AS DATE) AS d, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS med FROM events GROUP BY 1, 2")
def agg19_class_date(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 3).alias("class"), F.to_date("ts").alias("d")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.median("value"), 6).alias("med"))


@query(
    "WITH b AS (SELECT unnest(range(0, 48, 3)) AS lo), m AS (SELECT floor(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 30.44) AS mo, o_orderstatus FROM orders)"
    " SELECT CAST(b.lo AS BIGINT) AS lo, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_o FROM b LEFT JOIN m ON m.mo >= b.lo AND m.mo < b.lo + 3 GROUP BY 1"
)
def agg20_hist(t: Tables) -> DataFrame:
    """Three-month bins up to 48, two series, empty bins kept, later values dropped."""
    months = F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 30.44)
    counts = t.orders.select((F.floor(months / 3) * 3).alias("lo"), "o_orderstatus").groupBy("lo").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"))
    bins = t.spark.range(0, 48, 3).withColumnRenamed("id", "lo")
    return bins.join(F.broadcast(counts), "lo", "left").fillna(0)


@query(
    "SELECT CASE WHEN mo < 6 THEN 0 WHEN mo < 12 THEN 6 WHEN mo < 18 THEN 12 WHEN mo < 24 THEN 18 WHEN mo < 30 THEN 24 WHEN mo < 36 THEN 30 WHEN mo < 42 THEN 36 WHEN mo < 48 THEN 42 WHEN mo < 60 THEN 48 END AS lo, count(*) AS n FROM (SELECT date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 30.44 AS mo FROM orders) WHERE mo >= 0 AND mo < 60 GROUP BY 1"
)
def agg21_bins(t: Tables) -> DataFrame:
    """Half-open bins with edges of their own."""
    mo = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 30.44
    edges = [0, 6, 12, 18, 24, 30, 36, 42, 48, 60]
    lo = F.when(mo < 0, None)
    for a, b in zip(edges, edges[1:], strict=False):
        lo = lo.when(mo < b, a)
    return t.orders.select(lo.alias("lo")).filter("lo is not null").groupBy("lo").agg(F.count("*").alias("n"))


@query(
    "WITH m AS (SELECT CAST(floor(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 30.44 + 0.5) AS BIGINT) AS mo, count(*) AS n FROM orders GROUP BY 1) SELECT mo, CAST(floor(100.0 * sum(n) OVER (ORDER BY mo) / (SELECT count(*) FROM orders) + 0.5) AS BIGINT) AS pct FROM m"
)
def agg22_cumulative(t: Tables) -> DataFrame:
    """Share of events by month, cumulative. Months are few whatever the rows, so the ordered window is small."""
    mo = F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 30.44 + 0.5)
    per = t.orders.groupBy(mo.alias("mo")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per.select("mo", F.floor(100.0 * F.sum("n").over(Window.orderBy("mo").rowsBetween(Window.unboundedPreceding, 0)) / total + 0.5).alias("pct"))


@query(
    "WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p, min(CASE WHEN event_type = 'click' THEN ts END) AS c FROM events GROUP BY 1), d AS (SELECT abs(date_diff('day', CAST(c AS DATE), CAST(p AS DATE))) AS delta FROM f WHERE p IS NOT NULL AND c IS NOT NULL)"
    " SELECT CAST(k.tol AS BIGINT) AS tol, round(100.0 * avg(CASE WHEN d.delta <= k.tol THEN 1.0 ELSE 0.0 END), 6) AS pct FROM d, (SELECT unnest(range(0, 19)) AS tol) k GROUP BY 1"
)
def agg23_tolerance(t: Tables) -> DataFrame:
    """Share of pairs whose dates differ by at most 0 to 18 days: counts by difference first, so the tolerances meet
    one row a day, not every pair."""
    f = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("p"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("c")).dropna()
    days = f.groupBy(F.abs(F.datediff(F.to_date("p"), F.to_date("c"))).alias("delta")).agg(F.count("*").alias("n"))
    spread = days.withColumn("tol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(18).cast("long"))))
    return spread.groupBy("tol").agg(F.round(100.0 * F.sum(F.when(F.col("delta") <= F.col("tol"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("pct"))


@query(
    "WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p, min(CASE WHEN event_type = 'click' THEN ts END) AS c FROM events GROUP BY 1), d AS (SELECT CAST(date_diff('hour', c, p) AS DOUBLE) AS delta FROM f WHERE p IS NOT NULL AND c IS NOT NULL)"
    " SELECT count(*) AS n, round(median(delta), 6) AS med, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(100.0 * avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS pct_later FROM d"
)
def agg24_delta(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("p"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("c")).dropna()
    hour = lambda c: F.date_trunc("hour", F.col(c).cast("timestamp")).cast("long") / 3600
    d = f.select((hour("p") - hour("c")).alias("delta"))
    return d.agg(F.count("*").alias("n"), F.round(F.median("delta"), 6).alias("med"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_samp("delta"), 6).alias("std"), F.round(100.0 * F.avg((F.col("delta") > 0).cast("double")), 6).alias("pct_later"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r_price, round(corr(l_quantity, l_discount), 6) AS r_discount, round(corr(l_tax, l_discount), 6) AS r_tax FROM lineitem")
def agg25_corr(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r_price"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("r_discount"), F.round(F.corr("l_tax", "l_discount"), 6).alias("r_tax"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS status_null, CAST(sum(CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END) AS BIGINT) AS price_null FROM orders")
def agg27_nulls(t: Tables) -> DataFrame:
    """Nulls per column."""
    holes = t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"))
    return holes.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in holes.columns))


@query("SELECT event_type, value, round(CAST(rn AS DOUBLE) / n, 9) AS cdf FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def agg34_cdf(t: Tables) -> DataFrame:
    """Ranks by one range sort of all rows, less the number of the group's first: no group is sorted in one task."""
    rows = numbered(t.events.select("event_type", "value", "event_id"), ["event_type", "value", "event_id"], "place")
    sizes = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    # A row a group, few whatever the input.
    groups = sizes.select("event_type", "n", F.coalesce(F.sum("n").over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(groups, "event_type").select("event_type", "value", F.round((F.col("place") - F.col("before") + 1).cast("double") / F.col("n"), 9).alias("cdf"))


@query("SELECT arg_max(event_type, m) AS best, max(m) AS best_mean FROM (SELECT event_type, round(avg(value), 6) AS m FROM events GROUP BY 1)")
def agg35_best(t: Tables) -> DataFrame:
    means = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    return means.agg(F.max_by("event_type", "m").alias("best"), F.max("m").alias("best_mean"))


@query(
    "WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p, min(CASE WHEN event_type = 'click' THEN ts END) AS c FROM events GROUP BY 1)"
    " SELECT count(*) AS parcels, count(p) AS recovered, CAST(floor(100.0 * count(p) / count(*) + 0.5) AS BIGINT) AS pct, coalesce(median(CAST(date_diff('day', CAST(c AS DATE), CAST(p AS DATE)) AS DOUBLE)), 0) AS median_lag FROM f"
)
def agg36_kpis(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("p"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("c"))
    lag = F.datediff(F.to_date("p"), F.to_date("c")).cast("double")
    return f.agg(F.count("*").alias("parcels"), F.count("p").alias("recovered"), F.floor(100.0 * F.count("p") / F.count("*") + 0.5).alias("pct"), F.coalesce(F.median(lag), F.lit(0.0)).alias("median_lag"))


@query(
    "SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS urgent_date, min(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate END) AS high_date, count(*) AS n, max(o_totalprice) AS max_value FROM orders GROUP BY 1"
)
def agg33_permit_timeline(t: Tables) -> DataFrame:
    by = lambda p: F.min(F.when(F.col("o_orderpriority") == p, F.col("o_orderdate")))
    return t.orders.groupBy("o_custkey").agg(by("1-URGENT").alias("urgent_date"), by("2-HIGH").alias("high_date"), F.count("*").alias("n"), F.max("o_totalprice").alias("max_value"))


@query(
    "WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, month(o_orderdate) AS m FROM orders), cells AS (SELECT y, m, count(*) AS n FROM o GROUP BY 1, 2), ys AS (SELECT DISTINCT y FROM o), ms AS (SELECT DISTINCT m FROM o)"
    " SELECT ys.y AS y, min(coalesce(n, 0)) > 0 AS covered FROM ys CROSS JOIN ms LEFT JOIN cells ON cells.y = ys.y AND cells.m = ms.m GROUP BY 1"
)
def agg38_coverage(t: Tables) -> DataFrame:
    """Whether every class occurs in a fold: the table of both is filled with zeros, so one that lacks a class says so."""
    rows = t.orders.select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").alias("m"))
    months = list(range(1, 13))
    wide = rows.groupBy("y").pivot("m", months).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("y", (F.least(*(F.col(f"`{m}`") for m in months)) > 0).alias("covered"))
