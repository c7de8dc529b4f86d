"""Centroid clustering with integer vectors: Lloyd's rounds whose nearest centroids are found by annulus search.

Centroids are sorted by norm. By the triangle inequality a centroid at distance u or less has a norm within u of the
vector's own, so with u the distance to the centroid of the closest norm, two binary searches bound the candidates; these
are compared exactly, in integers, ties at the bound included. A round is one pass over the staged vectors: tasks send
the sums of their clusters, and k * (dims + 1) numbers come back to the driver.

Defined results: null vectors and vectors of another length, or with a component null or not finite, are left out;
repeated rows count each; fewer than k vectors start as many clusters; none give no rows; a null vec_id comes last in the
order of starts. A component that is not within +-2^27 after scaling is an error: squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, stage

#: 64-bit sums of squares hold for components up to this and for 64 dimensions.
LARGEST = 1 << 27
#: Vectors compared at a time.
BLOCK = 4096


class Annulus:
    """Nearest of ``centroids`` (k by dims, integers); of equally near ones the smaller number."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids.astype(np.int64) ** 2).sum(axis=1)
        self.number = np.argsort(squares, kind="stable")
        self.centroids = centroids.astype(np.int64)[self.number]
        self.norms = np.sqrt(squares[self.number].astype(np.float64))
        #: Exact comparisons made.
        self.compared = 0

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last but one place, in order of norms, of the centroids that can be nearest to each row of ``x``."""
        norms = np.sqrt((x**2).sum(axis=1).astype(np.float64))
        at = np.clip(np.searchsorted(self.norms, norms), 1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(x), np.int64)
        if len(self.norms) > 1:
            at -= norms - self.norms[at - 1] <= self.norms[at] - norms
        upper = np.sqrt(((x - self.centroids[at]) ** 2).sum(axis=1).astype(np.float64))
        # Norms and bounds are rounded; the slack is far above that, so nothing at the bound is lost.
        reach = upper + 1e-9 * (1 + norms + upper)
        return np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance for each row of ``x``."""
        cluster, distance = np.full(len(x), len(self.number), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for low in range(0, len(x), BLOCK):
            part = x[low : low + BLOCK].astype(np.int64)
            first, last = self.bounds(part)
            for k in range(first.min(), last.max()):
                rows = np.flatnonzero((first <= k) & (k < last))
                self.compared += len(rows)
                d = ((part[rows] - self.centroids[k]) ** 2).sum(axis=1)
                better = (d < distance[low + rows]) | (d == distance[low + rows]) & (self.number[k] < cluster[low + rows])
                distance[low + rows[better]], cluster[low + rows[better]] = d[better], self.number[k]
        return cluster, distance


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``v``, the integers floor(scale * x), of the rows that can be clustered."""
    x = F.col(vector_col)
    fit = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    safe = lambda c: F.when(F.abs(F.lit(float(scale)) * c.cast("double")) <= LARGEST, whole(c)).otherwise(F.raise_error(F.lit("a component is beyond 2^27 after scaling")).cast("long"))
    return vectors.filter(x.isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, safe).cast("array<int>").alias("v"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def starts(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least hashes of their ids, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = points.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def lloyd(points: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds; each non-empty one becomes the floor of its vectors' mean, exactly."""
    k, dims = centroids.shape
    for _ in range(rounds):
        shared = points.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search, sums = Annulus(shared.value), np.zeros((k, dims + 1), np.int64)
            for b in batches:
                x = _matrix(b, dims)
                if len(x):
                    cluster, _ = search.nearest(x)
                    order = np.argsort(cluster, kind="stable")
                    used, begin = np.unique(cluster[order], return_index=True)
                    sums[used, :dims] += np.add.reduceat(x[order], begin, axis=0)
                    sums[:, dims] += np.bincount(cluster, minlength=k)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["cell", "n"])

        got = points.select("v").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(k * (dims + 1), np.int64)
        total[got["cell"].to_numpy()] = got["n"].to_numpy()
        total = total.reshape(k, dims + 1)
        some = total[:, dims] > 0
        centroids = centroids.copy()
        centroids[some] = total[some, :dims] // total[some, dims:]
        shared.destroy()
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and squared ``distance`` of every vector."""
    shared, dims = points.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(shared.value)
        for b in batches:
            cluster, distance = search.nearest(_matrix(b, dims))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return points.select("id", "v").mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance) of all vectors that can be clustered, written, and the final centroids."""
    points = stage(scaled(vectors, id_col, vector_col, dims, scale), "centroids-points")
    first = starts(points, k, salt)
    if not len(first):
        return points.selectExpr("id", "0 AS cluster", "0L AS distance"), np.zeros((0, dims), np.int64)
    centroids = lloyd(points, first, rounds)
    rows = stage(assign(points, centroids), "centroids-rows")
    release(points)
    return rows, centroids


def op13_centroids(spark, sf_dir) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds, with inertia and a digest of each centroid."""
    small_batches(spark, 10_000)
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    inertia = dict(rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect())
    # One row a centroid, whatever the number of vectors.
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.withColumnRenamed("id", "vec_id").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
