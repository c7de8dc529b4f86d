"""Dense numbering and fixed-size batches without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written


def spread(df: DataFrame, *keys: str, each: int = 20_000, least: int | None = None) -> DataFrame:
    """``df`` in as many partitions as there are ``each`` rows, by ``keys`` or evenly. A small file makes one split, whatever
    a row of it costs later on; the number is set, so adaptive execution doesn't join the parts again. Counts ``df`` first.
    There are ``least`` parts in any case, by default one for each core."""
    return df.repartition(max(least or df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each)), *keys)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, 0, 1, 2 … in an order that no two rows share: a range sort, then the counts of its partitions
    as offsets (one row for each partition).

    The sorted rows are written once with their places: counts and rows from two runs of the sort, planned with other
    columns, may be cut into other partitions."""
    columns = df.columns
    placed = written(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33)), "numbered")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(F.broadcast(counts.select("__p", before.alias("__o"))), "__p")
    return joined.select(*columns, (F.col("__o") + F.col("__id") - F.shiftleft("__p", 33)).alias(out))
