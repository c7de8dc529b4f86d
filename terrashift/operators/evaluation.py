"""Scores, cross-validated models, components and clusters."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written
from .batches import spread


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by ranks, ties in the middle. Ranks come from counts by distinct score, sorted by range and
    written once; the ordered window runs within a range, and the ranges' totals (a row each) are the offsets."""
    counts = scored.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    placed = written(counts.orderBy("score").withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33)), "auc-scores")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("lower"))
    within = before(Window.partitionBy("range").orderBy("score"))
    ranked = placed.join(F.broadcast(ranges), "range").withColumn("mid", F.col("lower") + within + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def quantiles(rows: DataFrame, value: Column, shares: list[float]) -> DataFrame:
    """One row with ``q``, the quantiles of ``value`` at ``shares``, interpolated between neighbours; nulls don't count.

    Exact, and without a table of all values in one task: counts by distinct value are sorted by range and written once;
    running counts within the ranges and the ranges' totals (a row each) find the neighbours."""
    counts = rows.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = written(counts.orderBy("v").withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33)), "quantiles")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("range").agg(F.sum("n").alias("n"))
    ranges = totals.select("range", before(Window.orderBy("range")).alias("lower"), F.sum("n").over(Window.partitionBy()).alias("all"))
    first = F.col("lower") + before(Window.partitionBy("range").orderBy("v"))
    ranked = placed.join(F.broadcast(ranges), "range").select("v", first.alias("first"), (first + F.col("n")).alias("past"), "all")
    place = lambda p: (F.col("all") - 1) * F.lit(float(p))
    at = lambda i: F.max(F.when((F.col("first") <= i) & (i < F.col("past")), F.col("v")))
    found = ranked.agg(F.max("all").alias("all"), *(at(f(place(p))).alias(f"{n}{k}") for k, p in enumerate(shares) for n, f in (("a", F.floor), ("b", F.ceil))))
    a, b = (lambda k: F.col(f"a{k}").cast("double")), (lambda k: F.col(f"b{k}").cast("double"))
    between = lambda k, p: F.when(a(k) == b(k), a(k)).otherwise((F.ceil(place(p)) - place(p)) * a(k) + (place(p) - F.floor(place(p))) * b(k))
    return found.select(F.array(*(between(k, p) for k, p in enumerate(shares))).alias("q"))


def class_scores(rows: DataFrame, predicted: str, actual: str, classes: list[int]) -> DataFrame:
    """Counts, precision, recall and F1 per class, and the mean F1; no predictions count as zero."""
    p, y = F.col(predicted), F.col(actual)
    each = [F.struct(F.lit(c).alias("cls"), F.count_if((p == c) & (y == c)).alias("tp"), F.count_if(p == c).alias("predicted"), F.count_if(y == c).alias("actual")) for c in classes]
    table = rows.agg(F.array(*each).alias("c")).select(F.inline("c"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = table.withColumn("pr", zero(F.col("tp"), F.col("predicted"))).withColumn("re", zero(F.col("tp"), F.col("actual")))
    scored = scored.withColumn("f", zero(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")))
    return scored.select("cls", "tp", "predicted", "actual", F.round("pr", 6).alias("precision"), F.round("re", 6).alias("recall"), F.round("f", 6).alias("f1"), F.round(F.avg("f").over(Window.partitionBy()), 6).alias("macro_f1"))


def confusion(rows: DataFrame, predicted: str, actual: str, classes: list[int]) -> DataFrame:
    """actual, predicted, n, share of the actual class; every pair of classes has a row."""
    p, y = F.col(predicted), F.col(actual)
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.count_if((y == a) & (p == b)).alias("n"), F.count_if((y == a) & p.isin(classes)).alias("all")) for a in classes for b in classes]
    table = rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return table.select("actual", "predicted", "n", F.round(F.coalesce(F.try_divide("n", "all"), F.lit(0.0)), 6).alias("share"))


def collapse_rare(rows: DataFrame, column: str, least: int, other: str) -> DataFrame:
    """Categories with under ``least`` rows become one."""
    counts = rows.groupBy(column).agg(F.count("*").alias("__n"))
    kept = F.when(F.col("__n") < least, F.lit(other)).otherwise(F.col(column))
    return rows.join(counts, column).withColumn(column, kept).drop("__n")


def one_hot(rows: DataFrame, column: str) -> DataFrame:
    """``column`` as an array of 0 and 1 for its categories in order, without the first. The categories are a row of the
    driver's plan: collapse rare ones first."""
    categories = [r[0] for r in rows.select(column).distinct().orderBy(column).collect()]
    return rows.withColumn(column, F.array(*((F.col(column) == c).cast("int") for c in categories[1:])))


def _model(kind: str):
    return {
        "logistic": lambda: LogisticRegression(maxIter=20, weightCol="w"),
        "svm": lambda: LinearSVC(maxIter=10, weightCol="w"),
        "forest": lambda: RandomForestClassifier(numTrees=10, maxDepth=5, seed=42, weightCol="w"),
        "boosted": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=42, weightCol="w"),
    }[kind]()


def cross_validate(rows: DataFrame, feature_sets: dict[str, list[str]], label: str, fold: str, models: list[str]) -> DataFrame:
    """features, model, macro_f1: predictions of each fold by a model of the others, classes weighted alike."""
    spark, out = rows.sparkSession, []
    rows = spread(rows, least=1)
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    share = rows.agg(F.avg(label)).first()[0]
    rows = rows.withColumn("w", F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))).cache()
    for name, columns in feature_sets.items():
        raw = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows.withColumnRenamed(label, "label"))
        assembled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw).cache()
        for kind in models:
            parts = None
            for k in folds:
                fitted = _model(kind).fit(assembled.filter(F.col(fold) != k))
                part = fitted.transform(assembled.filter(F.col(fold) == k)).select(F.col("prediction").cast("int").alias("p"), F.col("label").cast("int").alias("y"))
                parts = part if parts is None else parts.unionByName(part)
            out.append((name, kind, float(class_scores(parts, "p", "y", [0, 1]).first()["macro_f1"])))
    rows.unpersist()
    return spark.createDataFrame(out, "features string, model string, macro_f1 double")


def importance(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, importance by the impurity that a forest's splits remove."""
    assembled = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.withColumnRenamed(label, "label"))
    fitted = RandomForestClassifier(numTrees=20, maxDepth=6, seed=42).fit(assembled)
    return rows.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, fitted.featureImportances.toArray(), strict=True)], "feature string, importance double")


def pca_clusters(rows: DataFrame, key: str, vector: str, components: int, clusters: int) -> DataFrame:
    """key, pc1 …, cluster of standardised vectors."""
    v = rows.select(key, array_to_vector(vector).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(v).transform(v)
    reduced = PCA(k=components, inputCol="z", outputCol="pc").fit(scaled).transform(scaled)
    labelled = KMeans(k=clusters, seed=42, featuresCol="z", predictionCol="cluster").fit(reduced).transform(reduced)
    return labelled.select(key, *(vector_to_array("pc")[i].alias(f"pc{i + 1}") for i in range(components)), "cluster")
