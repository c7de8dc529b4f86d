"""Series, joins, sources, sinks and the stream against plain Python."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import evaluation, joins, recovery, series
from terrashift.sources import readers, shapefile, sinks


def frame(spark, values):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, i int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def smooth_by_loop(x, width=11):
    n, half = len(x), width // 2
    there = [v for v in x if v is not None]
    if len(there) >= 5:
        med = np.median(there)
        mad = np.median([abs(v - med) for v in there])
        x = [None if v is None or abs(v - med) > 3 * 1.4826 * mad else v for v in x]
    if n < width:
        return [None] * n
    near = lambda a, i: [v for v in a[max(0, i - half) : i + half + 1] if v is not None]
    roll = [np.mean(near(x, i)) if near(x, i) else None for i in range(n)]
    known = [i for i in range(n) if roll[i] is not None]
    if not known:
        return [None] * n
    fill = np.interp(range(n), known, [roll[i] for i in known])
    pad = np.concatenate([np.zeros(half), fill, np.zeros(half)])
    m = np.array([pad[i : i + width].sum() / width for i in range(n)])
    v = np.array([(pad[i : i + width] ** 2).sum() / width for i in range(n)]) - m * m
    noise = v.mean()
    out = np.where(v < noise, m, m + (fill - m) * (1 - noise / np.where(v == 0, np.nan, v)))
    return [None if len(near(x, i)) < max(1, half) else float(o) for i, o in enumerate(out)]


@pytest.mark.parametrize("seed", range(3))
def test_smooth(spark, seed):
    r = random.Random(seed)
    x = [None if r.random() < 0.25 else r.random() + (9 if r.random() < 0.05 else 0) for _ in range(40)]
    got = column(series.smooth(frame(spark, x), "x", "k", "i", "s"), "s")
    for a, b in zip(got, smooth_by_loop(x), strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9))


@pytest.mark.parametrize("x", [[None] * 20, [1.0] * 5, [None] * 15 + [1.0] * 3])
def test_smooth_edges(spark, x):
    got = column(series.smooth(frame(spark, x), "x", "k", "i", "s"), "s")
    assert [g is None for g in got] == [v is None for v in smooth_by_loop(x)]


@pytest.mark.parametrize("seed", range(4))
def test_crossing(spark, seed):
    r = random.Random(seed)
    x = [None if r.random() < 0.1 else r.random() for _ in range(60)]
    want = next((i for i in range(7, 56) if all(v is not None and v >= 0.3 for v in x[i : i + 5])), None)
    got = series.sustained_crossing(frame(spark, x), "x", F.lit(0.3), "k", "i", F.lit(7)).first().crossing
    assert got == want


def test_run_before_skip_does_not_count(spark):
    x = [1.0] * 9 + [0.0] * 3
    assert series.sustained_crossing(frame(spark, x), "x", F.lit(0.5), "k", "i", F.lit(5)).first().crossing is None


def test_mad_of_zero_rejects_what_differs(spark):
    got = column(series.reject_outliers(frame(spark, [1, 1, 1, 1, 1, 2]), "x", "k", "c"), "c")
    assert got == [1, 1, 1, 1, 1, None]
    assert column(series.reject_outliers(frame(spark, [1, 1, 9]), "x", "k", "c"), "c") == [1, 1, 9]


def test_quadratic(spark):
    r = np.random.default_rng(1)
    t = np.arange(20.0)
    y = 0.3 * (t - 7) ** 2 + r.normal(size=20)
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "k string, t double, y double")
    got = recovery.fit_quadratic(rows, "k", "t", "y").first()
    a, b, _ = np.polyfit(t, y, 2)
    assert got.a == pytest.approx(a, rel=1e-9) and got.vertex == pytest.approx(-b / 2 / a, rel=1e-9)


def test_bootstrap_equals_resampling(spark):
    r = np.random.default_rng(5)
    t, y = np.arange(15.0), r.normal(size=15)
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)], "k string, t double, y double")
    got = recovery.bootstrap_ci(rows, "k", "t", "y", recovery.multiplicities(spark, [15], 40)).first()
    rng = np.random.default_rng(42)
    fits = []
    for _ in range(40):
        i = rng.choice(15, 15, replace=True)
        fits.append(np.polyfit(t[i], y[i], 2)[0] * 1e4)
    assert (got.ci_lower, got.ci_upper) == pytest.approx(tuple(np.percentile(fits, [2.5, 97.5])), rel=1e-6)


def test_exponential_fit_recovers(spark):
    t = np.arange(30.0)
    y = 0.9 - 0.5 * np.exp(-t / 14)
    rows = spark.createDataFrame([("a", float(a), float(b), 0.9) for a, b in zip(t, y, strict=True)], "k string, t double, y double, base double")
    got = recovery.fit_exponential(rows, "k", "t", "y", "base").first()
    assert got.recovery_tau == 14.0 and got.recovery_cmin == pytest.approx(0.4, abs=1e-3) and got.recovery_r2 == 1.0


def test_baseline_needs_three(spark):
    rows = frame(spark, [1, 2, None, 4])
    assert recovery.baseline(rows, "k", "x", F.col("i") < 2).count() == 0
    assert recovery.baseline(rows, "k", "x", F.col("i") < 9).first().pre_baseline == pytest.approx(3.0)


def test_assert_unique(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert joins.assert_unique(rows.limit(1), "k").count() == 1
    with pytest.raises(Exception, match="rows share"):
        joins.assert_unique(rows, "k").collect()


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "01"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}},
        {"type": "Feature", "properties": {"id": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2]]], [[[5, 5], [6, 5], [6, 6]]]]}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    rows = readers.geojson(spark, str(tmp_path / "a.geojson"), "id string").collect()
    assert [(r.id, len(r.rings)) for r in rows] == [("01", 1), (None, 2)]
    sinks.geojson_lines(readers.geojson(spark, str(tmp_path / "a.geojson"), "id string"), ["id"], "rings", str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0]["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]] and lines[1]["properties"] == {"id": None}


def test_clean_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('" strap ", "n"\n" 0012 ",x\n0013,2.5\n')
    rows = readers.clean_csv(spark, str(tmp_path / "a.csv"), keys=("strap",), numbers=("n",)).collect()
    assert [tuple(r) for r in rows] == [("0012", None), ("0013", 2.5)]


def test_update_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(path)
    extra = spark.createDataFrame([("a", 0.5), ("a", 0.5)], "k string, e double")
    sinks.merge_column(spark.read.parquet(path), extra, "k", "e", path)
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "e").collect())) == [("a", 1, 0.5), ("b", 2, None)]
    assert readers.optional(spark, str(tmp_path / "missing")) is None


def test_per_key_and_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 0, None), ("b", 0, 1.0)], "k string, i int, x double")
    sinks.json_per_key(rows, "k", "i", ["i", "x"], str(tmp_path / "keys"))
    docs = {r.k: json.loads(r.value) for r in spark.read.text(str(tmp_path / "keys")).collect()}
    assert docs["a"] == [{"i": 0, "x": None}, {"i": 1, "x": 2.0}]
    lines = spark.createDataFrame([(f"{i:03}", f"line {i}") for i in range(100)], "id string, line string")
    sinks.text_batches(lines, ["id"], "line", 45, "head", str(tmp_path / "batches"))
    got = {r.batch: r.n for r in spark.read.text(str(tmp_path / "batches")).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 46, 1: 46, 2: 11}


def test_file_names(spark):
    files = spark.createDataFrame([("/x/S1_20220101T010203Z_a.h5", "g"), ("/x/S1_20211220T010203Z_a.h5", "g"), ("/x/S1_20220113T010203Z_a.h5", "g")], "path string, g string")
    dated = readers.acquisitions(files).join(files, "path")
    pairs = readers.consecutive_pairs(dated, "g").orderBy("pair_idx").collect()
    assert [(str(p.date1), str(p.date2)) for p in pairs] == [("2021-12-20", "2022-01-01"), ("2022-01-01", "2022-01-13")]


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"PARCEL_NO".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes((6, 0)) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 1, 65, 7) + b"\0" * 20 + field + b"\r" + b" 000042")
    spark.dataSource.register(shapefile.ShapefileSource)
    row = spark.read.format("shapefile").option("columns", "PARCEL_NO").load(str(tmp_path / "a.shp")).first()
    assert row.PARCEL_NO == "000042" and [(p.x, p.y) for p in row.geometry[0]] == ring


def test_stream(spark, tmp_path):
    from terrashift.streaming.crossing import crossings

    rows = [("a", i, 1.0 if i >= 3 else 0.0) for i in range(10)] + [("b", i, 0.0) for i in range(10)]
    spark.createDataFrame(rows, "key string, idx long, value double").withColumn("ts", F.timestamp_seconds(F.col("idx") * 86400)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, idx long, value double, ts timestamp").parquet(str(tmp_path / "in"))
    q = crossings(stream, 0.5).writeStream.format("memory").queryName("crossed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("crossed").collect()] == [("a", 3)]


def test_auc_by_pairs(spark):
    """Half of ties count; more distinct scores than a range holds."""
    r = random.Random(8)
    rows = [(r.choice((r.random(), round(r.random(), 1))), int(r.random() < 0.3)) for _ in range(400)]
    scored = spark.createDataFrame(rows, "s double, y int").repartition(5)
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))
    assert evaluation.auc(scored, "s", "y").first().auc == pytest.approx(want)
    assert evaluation.auc(scored.filter("y = 1"), "s", "y").first().auc is None
    assert evaluation.auc(scored.limit(0), "s", "y").first().auc is None


@pytest.mark.parametrize("failing", [1, 2])
def test_failed_rename_keeps_the_table(spark, tmp_path, monkeypatch, failing):
    path, calls = str(tmp_path / "t"), []

    def renamed(fs, source, target):
        calls.append(source)
        return len(calls) != failing and fs.rename(source, target)

    spark.range(3).write.parquet(path)
    monkeypatch.setattr(sinks, "_renamed", renamed)
    with pytest.raises(OSError, match="unchanged"):
        sinks.update_in_place(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    failing = 0
    sinks.update_in_place(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
