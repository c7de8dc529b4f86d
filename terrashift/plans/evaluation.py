"""Scores against truth, features and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import evaluation as E
from ..operators import models as M
from .registry import Tables, query


@query(
    "WITH s AS (SELECT d.doc_id, d.n_chars AS score, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s), k AS (SELECT sum(CASE WHEN y = 1 THEN rk END) AS rs, CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS p, CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS n FROM r) SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS auc FROM k"
)
def st11_auc(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", F.col("n_chars").alias("score")).join(t.labels.select("doc_id", F.col("quality").alias("y")), "doc_id")
    return E.auc(scored, "score", "y").select(F.round("auc", 6).alias("auc"))


@query(
    "WITH s AS (SELECT CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS p, l.quality AS y FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT k AS cls, count(CASE WHEN p = k AND y = k THEN 1 END) AS tp, count(CASE WHEN p = k THEN 1 END) AS pp, count(CASE WHEN y = k THEN 1 END) AS yy FROM s, (SELECT unnest([0, 1]) AS k) GROUP BY 1), f AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS prec, CASE WHEN yy > 0 THEN tp / yy ELSE 0 END AS rec FROM c)"
    " SELECT CAST(cls AS INTEGER) AS cls, tp, pp AS predicted, yy AS actual, round(CAST(prec AS DOUBLE), 6) AS \"precision\", round(CAST(rec AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS DOUBLE), 6) AS f1, round(CAST(avg(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END) OVER () AS DOUBLE), 6) AS macro_f1 FROM f"
)
def st12_f1(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", (F.col("n_chars") > 500).cast("int").alias("p")).join(t.labels.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    return E.class_scores(scored, "p", "y", [0, 1])


@query(
    "WITH k AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_partkey, CASE WHEN k.n < 80 THEN 'OTHER' ELSE p.p_brand END AS brand, coalesce(CASE WHEN p_size > 5 THEN p_size END, (SELECT median(CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) END) FROM part)) AS size FROM part p JOIN k USING (p_brand)) SELECT p_partkey, brand, round((size - (SELECT avg(size) FROM b)) / (SELECT stddev_pop(size) FROM b), 6) AS z FROM b"
)
def st13_features(t: Tables) -> DataFrame:
    """Rare categories collapsed, gaps filled with the median, scaled by the population's deviation."""
    rare = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    size = F.when(F.col("p_size") > 5, F.col("p_size").cast("double"))
    med = t.part.agg(F.median(size).alias("med"))
    rows = t.part.join(rare, "p_brand").join(F.broadcast(med)).select("p_partkey", F.when(F.col("n") < 80, "OTHER").otherwise(F.col("p_brand")).alias("brand"), F.coalesce(size, F.col("med")).alias("size"))
    stats = rows.agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("std"))
    return rows.join(F.broadcast(stats)).select("p_partkey", "brand", F.round((F.col("size") - F.col("mean")) / F.col("std"), 6).alias("z"))


@query()
def st14_classifier(t: Tables) -> DataFrame:
    """Models by fold: logistic regression, linear support vectors, random forest and boosted trees, macro-F1 each."""
    rows = t.customer.select("c_acctbal", (F.col("c_custkey") % 97).cast("double").alias("k"), F.pmod(F.xxhash64("c_custkey"), F.lit(2)).alias("fold"), (F.col("c_acctbal") + F.col("c_custkey") % 97 * 40 > 6000).cast("double").alias("label"))
    return E.cross_validate(rows, {"balance": ["c_acctbal"], "both": ["c_acctbal", "k"]}, "label", "fold", ["logistic", "svm", "forest", "boosted"])


@query()
def st14_three_classes(t: Tables) -> DataFrame:
    """Macro-F1 of three classes that lie in rings, by model and feature set: mean and deviation over the folds."""
    k = F.col("c_custkey")
    a, b = (k % 97) / 48.5 - 1, (k * 31 % 89) / 44.5 - 1
    r = F.sqrt(a * a + b * b)
    rows = t.customer.select(a.alias("a"), b.alias("b"), F.when(r < 0.5, 0).when(r < 0.9, 1).otherwise(2).alias("y"), (k % 2).cast("int").alias("fold"))
    found = M.cross_validate_classes(rows, {"position": ["a", "b"]}, "y", "fold", ("logistic", "kernel"), gamma=1.0)
    return found.groupBy("features", "model").agg(F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1"))


@query()
def st16_importance(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), F.length("p_name").cast("double").alias("c"), (F.col("p_size") > 25).cast("double").alias("label"))
    return E.importance(rows, ["a", "b", "c"], "label")


@query()
def st17_pca_kmeans(t: Tables) -> DataFrame:
    """Two components and four clusters of standardised series."""
    from .series import daily

    filled = daily(t).fillna(50.0, ["x"]).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s"))
    return E.pca_clusters(filled.select("user_id", F.transform("s", lambda p: p["x"]).alias("v")), "user_id", "v", 2, 4)


@query()
def st16_attributions(t: Tables) -> DataFrame:
    """Mean absolute Shapley value of each feature over all parts, of a forest that tells large parts."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = ["p_size", "p_retailprice", "name_length"]
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.length("p_name").cast("double").alias("name_length"), (F.col("p_size") + F.col("p_retailprice") % 50 > 40).cast("double").alias("label"))
    fitted = RandomForestClassifier(numTrees=20, maxDepth=5, seed=42).fit(VectorAssembler(inputCols=columns, outputCol="features").transform(rows))
    return A.mean_absolute(A.attributions(rows, "p_partkey", columns, fitted), columns)
