"""Means that stand before a threshold or a floor are added in the order of the table, however its files are split."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrashift.plans import mart, series
from terrashift.plans.registry import Tables


def plain(rows):
    """Means by key of (key, value) pairs, added one by one."""
    sums = defaultdict(lambda: [0.0, 0])
    for k, v in rows:
        sums[k][0] += v
        sums[k][1] += 1
    return {k: (s / n, n) for k, (s, n) in sums.items()}


@pytest.fixture(scope="module")
def split_dir(spark, tmp_path_factory):
    """Tables in eight files each, so that no key's rows lie in one file."""
    path, rng = str(tmp_path_factory.mktemp("split")), random.Random(7)
    day = datetime(1996, 1, 1)
    lines = [(i, rng.randrange(60), day + timedelta(days=rng.randrange(900)), rng.randrange(11) / 100, rng.randrange(9) / 100, float(rng.randrange(1, 51)), "R", "O") for i in range(4000)]
    events = [(i, rng.randrange(20), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(720)), rng.randrange(20000) / 100) for i in range(4000)]
    for name, rows, kind in (("lineitem", lines, "i long, l_partkey long, l_shipdate timestamp_ntz, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string"), ("events", events, "i long, user_id long, ts timestamp_ntz, value double")):
        spark.createDataFrame(rows, kind).repartitionByRange(8, "i").sortWithinPartitions("i").write.parquet(f"{path}/{name}.parquet")
    return path, lines, events


def test_mart_means_in_table_order(spark, split_dir):
    path, lines, _ = split_dir
    t = Tables(spark, path)
    landsat = {(r.parcel_idx, r.observation_date): r for r in mart.stg_landsat(t).collect()}
    sar = {(r.parcel_idx, r.observation_date): r for r in mart.stg_sar(t).collect()}
    key = lambda x: (x[1], str(x[2].year))
    dnbr, ndvi, vv = (plain((key(x), f(x)) for x in lines) for f in (lambda x: x[3] * 8, lambda x: x[5] / 50, lambda x: 0 - x[4] * 100))
    assert {k: r.dnbr_mean for k, r in landsat.items()} == {k: v[0] for k, v in dnbr.items()}
    assert {k: r.ndvi_mean for k, r in landsat.items()} == {k: v[0] for k, v in ndvi.items()}
    assert {k: (r.vv_change_db_mean, r.vv_pixel_count) for k, r in sar.items()} == vv


def test_daily_means_in_table_order(spark, split_dir):
    path, _, events = split_dir
    want = plain(((x[1], (x[2] - datetime(2024, 1, 1)).days), x[3]) for x in events)
    got = {(r.user_id, r.d): r.x for r in series.daily(Tables(spark, path)).filter(F.col("x").isNotNull()).collect()}
    assert got == {k: v[0] for k, v in want.items()}
