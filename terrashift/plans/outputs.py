"""Results as documents and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import numbered
from .registry import Tables, query
from .series import SERIES, daily


@query(f"WITH {SERIES} SELECT user_id, '[' || string_agg('{{\"d\":' || d || ',\"x\":' || coalesce(CAST(CAST(floor(x * 100) AS BIGINT) AS VARCHAR), 'null') || '}}', ',' ORDER BY d) || ']' AS doc FROM s GROUP BY 1")
def snk04_json_series(t: Tables) -> DataFrame:
    """A document per key: its series in order, nulls kept."""
    point = F.struct("d", F.floor(F.col("x") * 100).alias("x"))
    series = daily(t).groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("s"))
    return series.select("user_id", F.to_json("s", {"ignoreNullFields": "false"}).alias("doc"))


@query(
    "WITH l AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 45 AS batch, c_custkey || '|' || CAST(CAST(round(c_acctbal, 0) AS BIGINT) AS VARCHAR) || '|' || CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE CAST(c_custkey % 3 AS VARCHAR) END AS line FROM customer) SELECT CAST(batch AS BIGINT) AS batch, string_agg(line, chr(10) ORDER BY c_custkey) AS body, count(*) AS n FROM l GROUP BY 1"
)
def snk05_batches(t: Tables) -> DataFrame:
    """Batches of 45 encoded lines."""
    k = F.col("c_custkey")
    line = F.concat_ws("|", k.cast("string"), F.round("c_acctbal", 0).cast("long").cast("string"), F.when(k % 3 == 0, "none").otherwise((k % 3).cast("string")))
    rows = numbered(t.customer.select("c_custkey", line.alias("line")), ["c_custkey"], "n").withColumn("batch", F.floor(F.col("n") / 45))
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))).alias("l"), F.count("*").alias("n"))
    return grouped.select("batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"), "n")


@query("SELECT n_nationkey, '{\"type\":\"Feature\",\"properties\":{\"name\":\"' || n_name || '\"},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',' || n_regionkey || ']}}' AS feature FROM nation")
def snk03_features(t: Tables) -> DataFrame:
    geometry = F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), geometry.alias("geometry"))
    return t.nation.select("n_nationkey", F.to_json(feature).alias("feature"))


@query("SELECT c, '{' || string_agg('\"' || o_orderstatus || '\":' || n, ',' ORDER BY o_orderstatus) || '}' AS summary FROM (SELECT o_orderpriority AS c, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def snk07_summary(t: Tables) -> DataFrame:
    """Nested counts per class as one document."""
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("c"), "o_orderstatus").agg(F.count("*").alias("n"))
    entries = counts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))).alias("e"))
    return entries.select("c", F.to_json(F.map_from_entries("e")).alias("summary"))


@query("WITH m AS (SELECT o_custkey, round(avg(o_totalprice) + 1e-6, 2) AS estimate FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c.c_custkey, c.c_mktsegment, m.estimate FROM customer c LEFT JOIN m ON m.o_custkey = c.c_custkey")
def st09_merge_estimates(t: Tables) -> DataFrame:
    """Batches of external estimates joined on: one row a key, the first of several by order, absent ones null."""
    estimates = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice") + 1e-6, 2).alias("estimate"))
    return t.customer.select("c_custkey", "c_mktsegment").join(estimates, "c_custkey", "left")
