"""Connected components by alternating large and small stars: rounds grow with the logarithm of a component's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import deleted, written


def _large_star(pairs: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of the node and its neighbours."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    others = pairs.join(least, "v").filter("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return least.select(F.col("m").alias("u"), "v").union(others).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node that has an edge to another.

    Every round is written and the one before deleted; it ends when a round changes nothing."""
    pairs = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct(), "components")
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(pairs)
    while True:
        after = written(_small_star(_large_star(pairs)), "components")
        now = state(after)
        deleted(pairs)
        pairs = after
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select("u", "u").distinct())
