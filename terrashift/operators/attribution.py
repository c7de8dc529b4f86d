"""Shapley values of a fitted forest's predictions, from its nodes as rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import shared_dir, written

_NODE = "struct<feature:int,threshold:double,left:boolean,share:double>"


def nodes(model, spark) -> DataFrame:
    """tree, id, left, right, feature, threshold, value, cover of the nodes of a random forest.

    The value is the prediction of a regression, or the share of class 1; the cover is what of the training weight came
    by. The forest is saved and its nodes are read, so they never pass through the driver."""
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    stats = n["impurityStats"]
    sorts = hasattr(model, "numClasses") and model.numClasses > 1
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value, cover = (stats[1] / total, total) if sorts else (n["prediction"], stats[0])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"), value.alias("value"), cover.alias("cover"),
    )


def leaf_paths(tree_nodes: DataFrame) -> DataFrame:
    """tree, value, ``path`` of each leaf: for every split on the way its feature and threshold, whether the left branch is
    taken, and the share of the cover that goes there. A join a level, over rows as few as a forest has nodes."""
    found = tree_nodes.filter("id = 0").withColumn("path", F.expr(f"cast(array() as array<{_NODE}>)"))
    out = None
    while True:
        leaves = found.filter("left < 0").select("tree", "value", "path")
        out = leaves if out is None else out.unionByName(leaves)
        inner = found.filter("left >= 0")
        if inner.isEmpty():
            return out
        steps = inner.select("tree", "path", F.col("cover").alias("above"), "feature", "threshold", F.explode(F.array(F.struct(F.col("left").alias("id"), F.lit(True).alias("is_left")), F.struct(F.col("right").alias("id"), F.lit(False).alias("is_left")))).alias("to"))
        steps = steps.select("tree", F.col("to.id").alias("id"), F.col("to.is_left").alias("is_left"), "path", "above", F.col("feature").alias("by"), F.col("threshold").alias("at"))
        taken = F.struct(F.col("by").alias("feature"), F.col("at").alias("threshold"), F.col("is_left").alias("left"), (F.col("cover") / F.col("above")).alias("share"))
        # Written, as lineage would double with every level.
        found = written(steps.join(tree_nodes, ["tree", "id"]).withColumn("path", F.concat("path", F.array(taken))).select(*tree_nodes.columns, "path"), "forest-level")


class Leaf:
    """A leaf's box, a feature once, and its share in every feature's value for each pattern of features inside the box."""

    def __init__(self, value: float, path: list[dict]):
        self.features = sorted({s["feature"] for s in path})
        d = len(self.features)
        self.low, self.high, z = np.full(d, -math.inf), np.full(d, math.inf), np.ones(d)
        for s in path:
            j = self.features.index(s["feature"])
            z[j] *= s["share"]
            if s["left"]:
                self.high[j] = min(self.high[j], s["threshold"])
            else:
                self.low[j] = max(self.low[j], s["threshold"])
        self.expected = value * z.prod()
        patterns = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        self.values = np.zeros((1 << d, d))
        for i in range(d):
            # Coefficients of the product of (z + o t) over the other features: t counts those that are known.
            rest = np.zeros((1 << d, d))
            rest[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    grown = rest * z[j]
                    grown[:, 1:] += rest[:, :-1] * patterns[:, j, None]
                    rest = grown
            weight = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
            self.values[:, i] = value * (patterns[:, i] - z[i]) * (rest @ weight)

    def pattern(self, x: np.ndarray) -> np.ndarray:
        inside = (x[:, self.features] > self.low) & (x[:, self.features] <= self.high)
        return inside @ (1 << np.arange(len(self.features)))


def attributions(rows: DataFrame, key: str, columns: list[str], model) -> DataFrame:
    """key, ``base``, ``phi``: what each of ``columns`` adds to the mean prediction, in the forest's order of features.

    Path-dependent values: of a feature that isn't known, a split goes either way by the training weight that went there.
    A leaf's part depends on which features put the row inside its box alone, so it is worked out once for each pattern;
    a row looks its pattern up in every leaf. The leaves are broadcast: at most trees x 2^depth."""
    spark = rows.sparkSession
    found = leaf_paths(nodes(model, spark)).orderBy("tree", "value").collect()
    trees = len({r["tree"] for r in found})
    shared = spark.sparkContext.broadcast([(r["value"] / trees, [s.asDict() for s in r["path"]]) for r in found])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = [Leaf(v, p) for v, p in shared.value]
        base = sum(leaf.expected for leaf in leaves)
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if b.num_rows else np.zeros((0, n))
            phi = np.zeros((len(x), n))
            for leaf in leaves:
                if leaf.features:
                    phi[:, leaf.features] += leaf.values[leaf.pattern(x)]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("__k"), pa.array(np.full(len(x), base)), values], ["k", "base", "phi"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("__k"), *columns).mapInArrow(run, f"k {kind}, base double, phi array<double>").withColumnRenamed("k", key)


def mean_absolute(values: DataFrame, columns: list[str]) -> DataFrame:
    """feature, importance: the mean absolute attribution of each column."""
    named = values.select(F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("phi").alias("v"))).alias("p"))
    return named.groupBy("p.feature").agg(F.avg(F.abs("p.v")).alias("importance"))
