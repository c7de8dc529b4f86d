"""Staged tables go when what reads them is written."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from terrashift.llm.common import bitmap, in_bitmap, recording, release, stage, sweep


def folders(spark):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).iterdir() if "-" in p.name and p.name.rsplit("-", 1)[0][0].isalpha() and any(p.iterdir())}


def test_pipeline_leaves_what_its_result_reads(spark, small_dir):
    before = folders(spark)
    out = corpus_pipeline.run(spark, small_dir)
    assert out.count() > 0
    left = folders(spark) - before
    assert {x.rsplit("-", 1)[0] for x in left} == {"packing-tokens"}


def test_sweep_keeps_what_is_read(spark):
    tables = []
    with recording(tables):
        a, b, c = (stage(spark.range(n), f"sweep-{n}") for n in (3, 4, 5))
        release(c)
    outside = stage(spark.range(6), "sweep-6")
    assert tables == [a, b] and outside.count() == 6
    sweep(tables, a.filter("id > 0"))
    assert tables == [a] and a.count() == 3 and not any(x.startswith("sweep-4") or x.startswith("sweep-5") for x in folders(spark))
    release(a, outside)


def test_bitmap(spark):
    n = 1 << 12
    rows = spark.range(0, 40_000, numPartitions=5).select(F.pmod(F.xxhash64("id") % 500 * 37, F.lit(n)).alias("bit"))
    want = {r.bit for r in rows.collect()}
    got = in_bitmap(bitmap(rows, n), np.arange(n))
    assert set(np.flatnonzero(got).tolist()) == want
    assert not bitmap(rows.limit(0), n).any() and bitmap(spark.range(n).withColumnRenamed("id", "bit"), n).min() == 255
