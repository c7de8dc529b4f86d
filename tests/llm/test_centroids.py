"""Annulus search against all distances, clusters against plain Python, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from terrashift.llm import centroids


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_all_distances(seed):
    r = np.random.default_rng(seed)
    k, dims = int(r.integers(1, 40)), int(r.integers(1, 6))
    # Few values, so ties of distances and of norms are common; repeated centroids too.
    c = r.integers(-4, 5, (k, dims)) * (1 << 24 if seed % 2 else 1)
    x = r.integers(-5, 6, (5000, dims)) * (1 << 24 if seed % 2 else 1)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, distance = centroids.Annulus(c).nearest(x)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_search_skips_other_norms():
    r = np.random.default_rng(1)
    c = r.normal(0, 1, (200, 8))
    c = (c / np.linalg.norm(c, axis=1, keepdims=True) * np.arange(1, 201)[:, None] * 1000).astype(np.int64)
    search = centroids.Annulus(c)
    search.nearest(c + r.integers(-50, 50, c.shape))
    assert search.compared < 0.2 * 200 * 200


def plain(rows, k, rounds):
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda p: (hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), p[1]))
    c = [p[1] for p in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            c[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted((i, j, d, sum(e for _, e, f in found if f == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


@pytest.mark.parametrize("n", [0, 3, 60])
def test_query(spark, tmp_path, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(np.float32(v)) for v in r.normal(0, 0.2, 64) + (i % 5)]) for i in range(n)]
    odd = [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] * 64), (905, [])]
    same = [(906, [-0.5] * 64)] * 3 + [(907, [-0.5] * 64)] if n == 60 else []
    spark.createDataFrame([(*x, "taken", "taken") for x in rows + odd + same], "vec_id long, embedding array<float>, id string, cluster string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = centroids.op13_centroids(spark, str(tmp_path))
    assert dict(df.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted(map(tuple, df.collect())) == plain(rows + odd + same, 8, 10)


def test_too_large_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster(rows)


def test_other_shapes(spark):
    rows = spark.createDataFrame([(str(i), [float(i // 10 * 100 + i % 3), 1.0]) for i in range(30)], "name string, point array<double>")
    found, c = centroids.cluster(rows, "name", "point", k=3, rounds=20, dims=2, scale=1, salt="s")
    assert c.shape == (3, 2) and found.count() == 30 and found.groupBy("cluster").count().count() <= 3
