"""Classifiers of several classes held against folds, with a kernel machine by random Fourier features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import spread
from .evaluation import class_scores

MODELS = ("logistic", "kernel", "forest", "boosted")


def fourier_features(rows: DataFrame, vector: str, size: int, out: str, n: int = 64, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """Adds ``out``: n cosines whose inner products stand for exp(-gamma |x - y|^2) of the vectors of ``size`` numbers.

    The frequencies are drawn once from the kernel's spectrum, so a row's features depend on that row alone and a linear
    machine over them is a kernel machine that no pair of rows has to be compared for. ``gamma``: one over ``size``."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(0, np.sqrt(2 * (gamma or 1 / size)), (n, size)), rng.uniform(0, 2 * np.pi, n)

    def waves(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, size))
        return pd.Series(list(np.cos(x @ w.T + shift) * np.sqrt(2 / n)))

    return rows.withColumn(out, array_to_vector(F.pandas_udf(waves, "array<double>")(vector_to_array(vector))))


def _model(kind: str, features: str):
    rest = lambda m: OneVsRest(classifier=m, featuresCol=features, weightCol="w")
    return {
        "logistic": lambda: LogisticRegression(maxIter=50, featuresCol=features, weightCol="w"), "kernel": lambda: rest(LinearSVC(maxIter=30, featuresCol=features)),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, seed=42, featuresCol=features, weightCol="w"), "boosted": lambda: rest(GBTClassifier(maxIter=5, maxDepth=3, seed=42, featuresCol=features)),
    }[kind]()


def cross_validate_classes(rows: DataFrame, feature_sets: dict[str, list[str]], label: str, fold: str, models: tuple[str, ...] = MODELS, gamma: float | None = None) -> DataFrame:
    """features, model, fold, macro_f1: a model of all other folds predicts each fold. Classes are 0, 1, 2 …; columns are
    scaled by the training folds' means and deviations, and classes weigh alike in training.
    Rows are spread by their number, as each step of a fit reads a part's features in one task."""
    spark, out = rows.sparkSession, []
    rows = spread(rows, least=1)
    counts = rows.groupBy(fold, F.col(label).cast("int").alias("y")).count().collect()
    folds, classes = sorted({r[fold] for r in counts}), sorted({r["y"] for r in counts})
    for name, columns in feature_sets.items():
        raw = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows.select(*dict.fromkeys(columns), F.col(label).cast("double").alias("label"), F.col(fold).alias("__fold")))
        for k in folds:
            size = {c: sum(r["count"] for r in counts if r["y"] == c and r[fold] != k) for c in classes}
            weight = reduce(lambda a, c: a.when(F.col("label") == c, sum(size.values()) / (len(classes) * max(size[c], 1))), classes, F.when(F.col("label").isNull(), 0.0))
            scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw.filter(F.col("__fold") != k)).transform(raw).withColumn("w", weight)
            scaled = fourier_features(scaled, "features", len(columns), "waves", gamma=gamma).persist()
            for kind in models:
                fitted = _model(kind, "waves" if kind == "kernel" else "features").fit(scaled.filter(F.col("__fold") != k))
                found = fitted.transform(scaled.filter(F.col("__fold") == k)).select(F.col("prediction").cast("int").alias("p"), F.col("label").cast("int").alias("y"))
                out.append((name, kind, int(k), float(class_scores(found, "p", "y", classes).first()["macro_f1"])))
            scaled.unpersist()
    return spark.createDataFrame(out, "features string, model string, fold int, macro_f1 double")
