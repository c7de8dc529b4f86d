"""Join operators that go beyond one call of ``join``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, which fails when it is read if two rows share a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = df.withColumn("__ok", F.assert_true(n == 1, F.lit(f"rows share a {key}")))
    return checked.filter(F.col("__ok").isNull()).drop("__ok")


def keep_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Those columns of ``names`` that are there, under their new names."""
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items() if old in df.columns))


def enrich(base: DataFrame, key: str, parts: list[tuple[DataFrame | None, str]]) -> DataFrame:
    """``base`` with the columns of each part by left joins on ``key``; of a part that is missing the columns are null.

    Each part is a table with one row a key, or None, and its columns as a schema. All joins are on one key, so a shuffle
    by it serves them all."""
    for part, schema in parts:
        fields = StructType.fromDDL(schema)
        if part is None:
            base = base.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields})
        else:
            base = base.join(part.select(key, *(F.col(f.name).cast(f.dataType) for f in fields)), key, "left")
    return base


def merge_first(base: DataFrame, extra: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """``base`` with ``column`` of the first row of each key in ``extra``; null where there is none."""
    first = extra.groupBy(key).agg(F.min_by(F.struct(column), F.struct(*order)).alias("__first"))
    return base.join(first.select(key, F.col(f"__first.{column}").alias(column)), key, "left")


def first_present(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sparse rows merged to one row a key: of each other column the first value in ``order`` that isn't null, null where
    all are. Columns are taken each by itself, so a row may give some and not others. Rows that tie in ``order`` give
    the lesser value."""
    others = [c for c in df.columns if c not in keys and c not in order]
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(*order, c))
    return df.groupBy(*keys).agg(*(F.min_by(c, at(c)).alias(c) for c in others))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``value`` of the key; ``default`` for a key that the table lacks, not for a null that it holds."""
    marked = table.select(key, value).withColumn("__found", F.lit(True))
    return df.join(marked, key, "left").withColumn(value, F.when(F.col("__found"), F.col(value)).otherwise(default)).drop("__found")


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, the earlier on a tie and then the lesser
    value; nulls for a key without right rows, or a left row without a time.

    Both sides go into one stream per key; what was seen last, forwards and backwards, are the two that can be nearest:
    one shuffle, no pairs, and equal left rows stay as many as they are."""
    kind = right.schema
    none = F.lit(None).cast(f"struct<t:{kind[right_time].dataType.simpleString()},v:{kind[value].dataType.simpleString()}>")
    l = left.select(F.col(key).alias("k"), F.col(left_time).alias("t"), F.struct(*left.columns).alias("row"), none.alias("r"))  # noqa: E741
    r = right.filter(F.col(right_time).isNotNull()).select(F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.struct(F.col(right_time).alias("t"), F.col(value).alias("v")).alias("r"))
    r = r.groupBy("k", "t").agg(F.first("row").alias("row"), F.min("r").alias("r"))
    by = Window.partitionBy("k")
    before = F.last("r", True).over(by.orderBy("t", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("r", True).over(by.orderBy(F.desc("t"), F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    seen = l.unionByName(r).select("*", before.alias("before"), after.alias("after")).filter("row is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    later = F.col("before").isNull() | (micros("after.t") - micros("t") < micros("t") - micros("before.t"))
    best = F.when(F.col("t").isNotNull(), F.when(later & F.col("after").isNotNull(), F.col("after")).otherwise(F.col("before")))
    return seen.select("row.*", best.alias("__r")).select(*left.columns, F.col("__r.t").alias(right_time), F.col("__r.v").alias(value))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the latest right row of its key at or before its time.

    Both sides go into one stream per key and the last seen right value is carried forward: one shuffle, no pairs."""
    columns = left.columns
    l = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[right_time].dataType).alias("__at"))  # noqa: E741
    r = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.col(right_time).alias("__at"))
    w = Window.partitionBy(key).orderBy("__t", "__side", F.col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    merged = l.unionByName(r).withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct(F.col("__at").alias("t"), F.col("__v").alias("v"))), True).over(w))
    return merged.filter("__side = 1").select("__row.*", F.col("__last.t").alias(right_time), F.col("__last.v").alias(value))
