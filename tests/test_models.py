"""Kernel features and models of three classes."""

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from terrashift.operators import evaluation, models


def test_inner_products_stand_for_the_kernel(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (12, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").select("i", array_to_vector("v").alias("v"))
    rows = models.fourier_features(df, "v", 3, "waves", n=400, gamma=0.3).select("i", vector_to_array("waves").alias("z")).orderBy("i").collect()
    z = np.array([r.z for r in rows])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert abs(z @ z.T - want).max() < 0.2 and abs(z @ z.T - want).mean() < 0.05


def test_rings_need_the_kernel(spark):
    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, (500, 2))
    radius = np.hypot(*x.T)
    y = np.digitize(radius, (0.45, 0.85))
    rows = spark.createDataFrame([(float(a), float(b), int(c), i % 2) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y int, fold int")
    got = models.cross_validate_classes(rows, {"both": ["a", "b"]}, "y", "fold", ("logistic", "kernel"), gamma=1.0)
    assert got.count() == 2 * 2
    mean = {(x.features, x.model): x.m for x in got.groupBy("features", "model").agg(F.avg("macro_f1").alias("m")).collect()}
    assert mean["both", "kernel"] > 0.8 > 0.6 > mean["both", "logistic"]


def test_a_task_reads_a_bounded_part(spark, monkeypatch):
    rows = spark.range(45_000).selectExpr("id % 7 / 7D as a", "cast(id % 3 as int) as y", "cast(id % 2 as int) as fold").coalesce(1)
    parts, waves = [], models.fourier_features
    monkeypatch.setattr(models, "fourier_features", lambda df, *a, **k: parts.append(df.rdd.getNumPartitions()) or waves(df, *a, **k))
    assert models.cross_validate_classes(rows, {"one": ["a"]}, "y", "fold", ("logistic",)).count() == 2
    assert parts == [3, 3]


def test_quantiles_of_many_values(spark):
    r = np.random.default_rng(3)
    for x in (r.normal(0, 100, 2001).round(1), np.array([5.0]), np.array([1.0, 2.0, 2.0, 2.0, 9.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
        got = evaluation.quantiles(df, F.col("x"), [0.0, 0.02, 0.5, 0.98, 1.0])
        assert np.allclose(got.first().q, np.quantile(x, [0, 0.02, 0.5, 0.98, 1]), rtol=1e-12)
    assert evaluation.quantiles(df.filter("x > 100"), F.col("x"), [0.5]).first().q == [None]


def test_products_gather_no_table_of_values(spark, small_dir):
    from terrashift import catalog

    plan = catalog.queries()["fn_products"](spark, small_dir)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
