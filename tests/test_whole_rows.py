"""No row lost or merged: numbering over many partitions, nearest joins, coverage, and queries that must return rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrashift import catalog
from terrashift.functions import classify
from terrashift.operators.batches import numbered
from terrashift.operators.joins import nearest
from terrashift.staging import shared_dir


@pytest.fixture
def many_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("64", "256k", "false"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_numbered_keeps_every_row(spark, many_partitions):
    n = 200_000
    rows = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("k"), *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512).alias(f"wide{i}") for i in range(3)))
    got = numbered(rows, ["k", "id"], "place")
    assert got.columns == [*rows.columns, "place"]
    assert got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place"), F.countDistinct("id")).first()[:] == (n, n, 0, n - 1, n)
    order = [r.k for r in got.filter("place < 50").orderBy("place").collect()]
    assert order == sorted(order) and order[0] == rows.agg(F.min("k")).first()[0]


def test_nearest_equals_a_loop(spark):
    day = datetime(2024, 1, 1)
    left = [("a", day), ("a", day), ("a", day + timedelta(days=400)), ("b", day), ("a", None), (None, day), ("c", day + timedelta(days=5))]
    right = [("a", day - timedelta(days=300), 1.0), ("a", day + timedelta(days=299), 2.0), ("c", day + timedelta(days=4), 7.0), ("c", day + timedelta(days=6), 3.0), ("c", day + timedelta(days=4), 5.0), ("a", None, 9.0)]
    got = nearest(spark.createDataFrame(left, "k string, at timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v double"), "k", "at", "ts", "v")
    want = []
    for k, at in left:
        found = sorted((abs((ts - at).total_seconds()), ts, v) for q, ts, v in right if q == k and ts is not None and at is not None)
        want.append((k, at, found[0][2] if found else None))
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(((r.k, r["at"], r.v) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["jn07_anti", "set_except"])
def test_differences_have_rows(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


def test_coverage_can_fail(spark):
    got = {r.y: r.covered for r in catalog.queries()["agg38_coverage"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got.values()) == {True, False}


@pytest.mark.parametrize(
    ("signals", "want"),
    [((0.1, 0.05, -9.0, 9.0), ("survived_no_fire", "high")), ((0.2, 0.05, -1.9, 9.0), ("survived_fire_exposed", "medium")), ((0.31, 0.5, -4.0, 0.0), ("total_loss", "high")), ((0.2, 0.5, -4.0, 0.0), ("total_loss", "medium")), ((0.25, 0.0, -3.0, 1.5), ("total_loss", "medium")), ((0.24, 0.2, -3.0, 9.0), ("partial_damage", "low"))],
)
def test_damage_tree(spark, signals, want):
    swir, dnbr, vv, tir = (F.lit(x) for x in signals)
    tree = classify.damage_tree(swir, dnbr, vv, tir)
    assert spark.range(1).select(tree, classify.damage_confidence(swir, tree, vv)).first()[:] == want


@pytest.mark.parametrize(("db", "want"), [(-8.1, "cleared_lot"), (-8.0, "destroyed"), (-6.0, "foundation_framing"), (-4.0, "structure_substantial"), (-1.5, "structure_substantial"), (-1.4, "rebuild_complete"), (None, None)])
def test_rebuild_stage(spark, db, want):
    assert spark.range(1).select(classify.rebuild_stage(F.lit(db).cast("double"))).first()[0] == want


def test_shared_dir_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
