"""Fits over series, attributions of forests and likeness of images against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from terrashift.operators import attribution, fits, similarity


def curve(t, base, cmin, tau):
    return base - (base - cmin) * np.exp(-(t - t[0]) / tau)


@pytest.mark.parametrize("seed", range(12))
def test_tau_equals_a_dense_scan(seed):
    r = np.random.default_rng(seed)
    t = np.sort(r.choice(80, 25, replace=False)).astype(float)
    base = r.uniform(0.5, 2)
    y = np.clip(curve(t, base, r.uniform(0, base), r.choice([1.0, 3.0, 12.0, 45.0, 80.0])) + r.normal(0, 0.03, 25), 0, base)
    tau, cmin, sse = fits.relaxation(t, y, base)
    taus = np.arange(1, 60.0005, 0.001)
    e = np.exp(-(t - t[0]) / taus[:, None])
    c = np.clip((e * (y - base * (1 - e))).sum(axis=1) / (e * e).sum(axis=1), 0, base)
    dense = ((y - base * (1 - e) - c[:, None] * e) ** 2).sum(axis=1)
    k = dense.argmin()
    assert abs(tau - taus[k]) <= 1e-3 and abs(cmin - c[k]) <= 1e-3 and sse <= dense[k] + 1e-12


def test_relaxation_rows(spark):
    t = np.arange(20.0)
    series = {1: curve(t, 1.0, 0.2, 7.3), 2: np.full(20, 0.5), 3: curve(t, 1.0, 0.2, 7.3)[:9], 4: curve(t, 1.0, 0.2, 7.3) + 0.9, 5: -curve(t, 1.0, 0.2, 7.3)}
    base = {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0, 6: 0.0}
    rows = [(k, float(a), float(b), base[k]) for k, v in series.items() for a, b in zip(t, v, strict=False)] + [(6, float(a), 0.0, 0.0) for a in t] + [(1, None, 0.3, 1.0), (1, 0.5, None, 1.0)]
    got = {x.k: x for x in fits.fit_relaxation(spark.createDataFrame(rows, "k int, t double, y double, base double").repartition(3), "k", "t", "y", "base").collect()}
    assert math.isclose(got[1].tau, 7.3, abs_tol=1e-4) and math.isclose(got[1].cmin, 0.2, abs_tol=1e-5) and got[1].r2 > 0.999999
    assert got[2].r2 == 0 and got[2].tau is None and got[2].cmin is not None
    assert all(got[k].r2 is None and got[k].cmin is None for k in (3, 4, 5, 6))


def test_bootstrap_limits_equal_a_loop(spark):
    r = np.random.default_rng(3)
    series = {k: (np.sort(r.choice(100, n, replace=False)).astype(float), r.normal(0, 1, n)) for k, n in ((1, 12), (2, 30), (3, 2), (4, 3))}
    rows = [(k, float(a), float(b)) for k, (x, y) in series.items() for a, b in zip(x, y, strict=True)]
    r.shuffle(rows)
    got = {int(x.k): x for x in fits.bootstrap_limits(spark.createDataFrame([(int(k), a, b) for k, a, b in rows], "k int, x double, y double"), "k", "x", "y").collect()}
    for k in (1, 2):
        x, y = series[k]
        rng = np.random.default_rng(42)
        found = []
        for _ in range(200):
            i = rng.choice(len(x), len(x), replace=True)
            found.append(np.polyfit(x[i], y[i], 2)[0] * 1e4)
        assert np.allclose((got[k].ci_lower, got[k].ci_upper), np.percentile(found, (2.5, 97.5)), rtol=1e-6)
    assert got[3].ci_lower is None


def test_hashed_times_are_those_of_spark(spark):
    times = fits.hashed_times(5, 4)
    rows = spark.range(4).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    by_hash = rows.select("b", "i", (F.conv(F.substring(F.md5(F.concat(F.col("b").cast("string"), F.lit("-"), F.col("i").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") % 3).alias("n")).collect()
    assert all(times[x.b, x.i] == x.n for x in by_hash)


def expectation(tree, x, known):
    """Prediction of one tree when only ``known`` features are; other splits go either way by cover."""

    def at(i):
        node = tree[i]
        if node["left"] < 0:
            return node["value"]
        left, right = tree[node["left"]], tree[node["right"]]
        if node["feature"] in known:
            return at(node["left"] if x[node["feature"]] <= node["threshold"] else node["right"])
        return (left["cover"] * at(node["left"]) + right["cover"] * at(node["right"])) / node["cover"]

    return at(0)


@pytest.mark.parametrize("kind", [RandomForestClassifier, RandomForestRegressor])
def test_attributions_equal_enumeration(spark, kind):
    r = np.random.default_rng(7)
    x = np.round(r.normal(0, 1, (300, 4)), 2)
    label = ((x[:, 0] * x[:, 1] + x[:, 2] > 0.2) if kind is RandomForestClassifier else x[:, 0] * x[:, 1] + x[:, 2]).astype(float)
    columns = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(i, *map(float, v), float(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "id int, a double, b double, c double, d double, label double")
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    model = kind(numTrees=5, maxDepth=4, seed=1).fit(assembled)
    got = {v.id: v for v in attribution.attributions(rows, "id", columns, model).collect()}
    predicted = {v.id: float(v.probability[1]) if kind is RandomForestClassifier else v.prediction for v in model.transform(assembled).collect()}
    assert len(got) == 300 and all(math.isclose(v.base + sum(v.phi), predicted[i], abs_tol=1e-9) for i, v in got.items())
    trees = {}
    for n in attribution.nodes(model, spark).collect():
        trees.setdefault(n["tree"], {})[n["id"]] = n
    for i in range(0, 300, 60):
        for f in range(4):
            others, want = [g for g in range(4) if g != f], 0.0
            for size in range(4):
                for s in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += weight * np.mean([expectation(t, x[i], {*s, f}) - expectation(t, x[i], set(s)) for t in trees.values()])
            assert math.isclose(got[i].phi[f], want, abs_tol=1e-9)
    table = {v.feature: v.importance for v in attribution.mean_absolute(attribution.attributions(rows, "id", columns, model), columns).collect()}
    assert math.isclose(table["a"], np.mean([abs(v.phi[0]) for v in got.values()]))
    assert attribution.attributions(rows.limit(0), "id", columns, model).count() == 0


def test_structural_similarity(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 256, (12, 15)).astype(float)
    images = {1: (a, a), 2: (a, np.clip(a + r.normal(0, 40, a.shape), 0, 255)), 3: (a, 255 - a), 4: (a[:6], a[:6]), 5: (np.full((9, 9), 7.0), np.full((9, 9), 9.0))}
    rows = [(k, int(i), int(j), float(v), float(b[i, j])) for k, (x, b) in images.items() for (i, j), v in np.ndenumerate(x)]
    got = {x.k: x.ssim for x in similarity.structural_similarity(spark.createDataFrame(rows, "k int, row int, col int, a double, b double").repartition(3), "k").collect()}

    def plain(x, y):
        values = []
        for i in range(x.shape[0] - 6):
            for j in range(x.shape[1] - 6):
                p, q = x[i : i + 7, j : j + 7].ravel(), y[i : i + 7, j : j + 7].ravel()
                c = np.cov(p, q)
                values.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
        return np.mean(values)

    assert got[4] is None and math.isclose(got[1], 1.0)
    assert all(math.isclose(got[k], plain(*images[k]), abs_tol=1e-9) for k in (1, 2, 3, 5))
    middle = spark.createDataFrame([(1, i, j, None if (i, j) == (3, 3) else 1.0, 1.0) for i in range(7) for j in range(7)], "k int, row int, col int, a double, b double")
    assert similarity.structural_similarity(middle, "k").first().ssim is None


def test_colour_distance(spark):
    r = np.random.default_rng(5)
    sides = [r.integers(0, 300, (40, 3)) for _ in range(2)]
    frames = [spark.createDataFrame([(1, *map(int, v)) for v in s] + [(2, 10, 10, 10)] * 3, "k int, r int, g int, b int") for s in sides]
    got = {x.k: x.distance for x in similarity.colour_distance(*frames, "k", ["r", "g", "b"]).collect()}
    hist = []
    for s in sides:
        s = s[(s < 256).all(axis=1)]
        h = np.zeros((16, 16, 16))
        np.add.at(h, tuple((s // 16).T), 1)
        hist.append(h.ravel() / len(s))
    assert math.isclose(got[1], math.sqrt(max(0, 1 - np.sqrt(hist[0] * hist[1]).sum())), abs_tol=1e-9) and math.isclose(got[2], 0, abs_tol=1e-7)
