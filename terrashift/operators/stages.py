"""Ordered folds by key with a carried state, in segments of bounded length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hold_monotone(df: DataFrame, key: str, order: list[str], stage: str, allowed: list[tuple[str, list[str]]], held: str = "held", flag: str = "uncertain", segment: int = 1024) -> DataFrame:
    """Adds ``held``, the stage after enforcing ``allowed`` steps, and ``flag`` where a row's own stage was impossible.

    The first known stage of a key is taken as it is. A stage that may not follow the held one is flagged and the held one
    stays; staying is no step; a null stage, or one that no step names, changes nothing, and only the latter is flagged.

    A row maps each state to a state, and such maps can be composed. So each segment of a key's rows is folded for every
    state it may be entered in, the segments' maps give the states they are entered in, and a second fold writes the rows:
    no array holds more than ``segment`` rows, or one map a segment, however long a key's series is."""
    names = list(dict.fromkeys([a for a, _ in allowed] + [b for _, after in allowed for b in after]))
    code = {n: i for i, n in enumerate(names, 1)}
    steps = [(code[a], [code[b] for b in after]) for a, after in allowed]

    def step(state: Column, s: Column) -> Column:
        may = reduce(lambda out, x: out | ((state == x[0]) & s.isin(x[1])), steps, state == 0)
        return F.when((s > 0) & may, s).otherwise(state)

    # -1: null, 0: a stage that no step names.
    as_code = reduce(lambda out, x: out.when(F.col(stage) == x[0], x[1]), code.items(), F.when(F.col(stage).isNull(), -1)).otherwise(0)
    w = Window.partitionBy(key).orderBy(*order)
    placed = df.withColumns({"__s": as_code, "__n": F.row_number().over(w)}).withColumn("__seg", F.floor((F.col("__n") - 1) / segment))
    row = F.struct("__n", "__s", F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    parts = placed.groupBy(F.col(key).alias("__k"), "__seg").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    states = F.array(*(F.lit(i) for i in range(len(names) + 1)))
    mapped = parts.withColumn("map", F.aggregate("rows", states, lambda acc, r: F.transform(acc, lambda st: step(st, r["__s"]))))
    entries = mapped.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__seg", "map"))).alias("maps"))
    entered = F.aggregate(
        "maps", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<__seg:bigint,entry:int>>)").alias("out")),
        lambda acc, m: F.struct(F.element_at(m["map"], acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(m["__seg"].alias("__seg"), acc["at"].alias("entry")))).alias("out")),
    )["out"]
    begun = mapped.drop("map").join(entries.select("__k", F.inline(entered)).withColumnRenamed("__k", "__k2").withColumnRenamed("__seg", "__seg2"), F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__seg") == F.col("__seg2")))
    kind = "array<struct<state:int,own:int>>"
    folded = F.aggregate(
        "rows", F.struct(F.col("entry").alias("at"), F.expr(f"cast(array() as {kind})").alias("out")),
        lambda acc, r: F.struct(step(acc["at"], r["__s"]).alias("at"), F.concat(acc["out"], F.array(F.struct(step(acc["at"], r["__s"]).alias("state"), r["__s"].alias("own")))).alias("out")),
    )["out"]
    rows = begun.select(F.inline(F.arrays_zip(F.col("rows.row").alias("row"), folded.alias("f"))))
    name_of = reduce(lambda out, x: out.when(F.col("f.state") == x[1], x[0]), list(code.items())[1:], F.when(F.col("f.state") == 1, names[0]))
    return rows.select("row.*", name_of.alias(held), ((F.col("f.own") == 0) | (F.col("f.own") > 0) & (F.col("f.own") != F.col("f.state"))).alias(flag))
