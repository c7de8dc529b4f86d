"""Readers and sinks over files written here, and what the geometry and merge functions give at their edges."""

import json
from datetime import date

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from terrashift.functions import geo
from terrashift.operators.joins import first_present
from terrashift.sources import readers, sinks
from terrashift.sources.stores import Store, store

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2]]
FAR = [[10, 0], [12, 0], [12, 2], [10, 2]]


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture
def features(tmp_path):
    rows = [feature("Polygon", [SQUARE, HOLE], id="a", n=1), feature("MultiPolygon", [[SQUARE, HOLE], [FAR]], id="b", n=None), feature("Point", [1, 2], id="c", n=3)]
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    return str(path)


def test_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, float("nan"), "x"), (2, 0.5, "y")], "id long, v double, s string").write.parquet(path)
    df = readers.parquet(spark, path, ["id", "v"])
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, 0.5)]
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<id:bigint,v:double>" in plan


def test_csv_keeps_strings(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n\n007,1\n,2\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv")).collect()] == [("007", "1"), (None, "2")]
    assert readers.csv(spark, str(tmp_path / "t.csv"), "id string, n int").dtypes == [("id", "string"), ("n", "int")]


def test_properties_only(spark, features):
    df = readers.properties_only(spark, features, "id string, n int")
    assert df.columns == ["id", "n"] and [tuple(r) for r in df.collect()] == [("a", 1), ("b", None), ("c", 3)]


def test_parts_keep_polygons_apart(spark, features):
    df = readers.geojson(spark, features, "id string", parts=True)
    sizes = {r.id: r.parts and [len(p) for p in r.parts] for r in df.collect()}
    assert sizes == {"a": [2], "b": [2, 1], "c": None}
    assert {r.id: r.rings and len(r.rings) for r in df.collect()} == {"a": 2, "b": 3, "c": None}
    outer = df.select("id", geo.outer_rings(F.col("parts")).alias("o"), F.transform("parts", geo.polygon_area).alias("a"))
    got = {r.id: (r.o and [(p[0].x, p[0].y) for p in r.o], r.a) for r in outer.collect()}
    assert got == {"a": ([(0, 0)], [15.0]), "b": ([(0, 0), (10, 0)], [15.0, 4.0]), "c": (None, None)}
    assert "parts" not in readers.geojson(spark, features, "id string").columns


def test_polygon_without_area(spark):
    ring = "array<struct<x double, y double>>"
    pts = lambda r: [tuple(map(float, p)) for p in r]
    flat = pts([[0, 0], [1, 1]])
    rows = [(1, [pts(SQUARE), pts(HOLE)]), (2, []), (3, None), (4, [flat]), (5, [pts(SQUARE), flat])]
    df = spark.createDataFrame(rows, f"k int, rings array<{ring}>")
    got = {r.k: (r.a, r.c and r.c.x) for r in df.select("k", geo.polygon_area(F.col("rings")).alias("a"), geo.polygon_centroid(F.col("rings")).alias("c")).collect()}
    assert got[1] == (15.0, pytest.approx((16 * 2 - 1.5) / 15))
    assert got[2] == (0.0, None) and got[3] == (None, None) and got[4] == (0.0, None) and got[5] == (16.0, 2.0)


def test_series_files_in_order_of_names(spark, tmp_path):
    for name, n in (("r2.json", 2), ("r10.json", 10), ("r1.json", 1), ("other.json", 9)):
        (tmp_path / name).write_text(json.dumps({"id": f"p{n}", "series": [n, None]}, indent=1))
    got = readers.series_files(spark, f"{tmp_path}/r*.json", "id string, series array<int>").collect()
    assert [(r.file, r.id, r.series) for r in got] == [("r1.json", "p1", [1, None]), ("r10.json", "p10", [10, None]), ("r2.json", "p2", [2, None])]


def test_registry(spark, tmp_path):
    for name in ("ndvi/ndvi_2022-06.tif", "ndvi/ndvi_202207.tif", "dem/dem.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.date) for r in readers.registry(spark, str(tmp_path)).collect()}
    assert got["dem.tif"] == ("dem", "unknown") and {k: v[0] for k, v in got.items()} == {"ndvi_2022-06.tif": "ndvi", "ndvi_202207.tif": "ndvi", "dem.tif": "dem"}
    assert got["ndvi_2022-06.tif"][1].replace("-", "").startswith("202206") and got["ndvi_202207.tif"][1].replace("-", "").startswith("202207")


def test_synthetic_grid_and_description(spark):
    made = readers.synthetic(spark, 4, ["2022-01", "2022-02"], seed=7)
    assert made.count() == 8 and made.dropDuplicates(["parcel_id", "observation_date"]).count() == 8
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, readers.synthetic(spark, 4, ["2022-01", "2022-02"], seed=7).collect()))
    cells = readers.grid(spark, -105.0, 40.0, 3, 2, 0.5).withColumn("a", geo.area(F.col("ring"))).collect()
    assert len(cells) == 6 and all(r.a == pytest.approx(0.25) for r in cells)
    assert {(r.ring[0].x, r.ring[0].y) for r in cells} == {(-105.0 + i / 2, 40.0 + j / 2) for i in range(3) for j in range(2)}
    assert [tuple(r) for r in readers.describe(made.select("parcel_id", "ndvi")).collect()] == [("parcel_id", "bigint"), ("ndvi", "double")]
    assert readers.grid(spark, 0, 0, 0, 5).count() == 0


def test_common_extent(spark):
    a = spark.createDataFrame([(r, c, 10.0 * r + c) for r in range(3) for c in range(5)], "row int, col int, value double")
    b = spark.createDataFrame([(r, c, -1.0) for r in range(4) for c in range(2)], "row int, col int, value double")
    got = {(r.row, r.col): (r.a, r.b) for r in readers.common_extent(a, b).collect()}
    assert got == {(r, c): (10.0 * r + c, -1.0) for r in range(3) for c in range(2)}


def test_box(spark):
    df = spark.range(1).select(geo.box(-2, 1, 4, 3).alias("r"))
    r = df.select("r", geo.area(F.col("r")).alias("a"), geo.bounds(F.col("r")).alias("b")).first()
    assert r.a == 12.0 and tuple(r.b) == (-2.0, 1.0, 4.0, 3.0) and len(r.r) == 4


def test_copy_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(256)) * 100)
    sinks.copy_file(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/sub/b")
    assert (tmp_path / "sub" / "b").read_bytes() == (tmp_path / "a").read_bytes() and (tmp_path / "a").exists()
    with pytest.raises(Exception, match="missing"):
        sinks.copy_file(spark, f"file://{tmp_path}/missing", f"file://{tmp_path}/c")


def test_save_model(spark, tmp_path):
    rows = VectorAssembler(inputCols=["x"], outputCol="f").transform(spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(9)], "x double, y double"))
    path = f"file://{tmp_path}/m"
    for reg in (0.5, 0.0):  # the second takes the place of the first
        model = LinearRegression(featuresCol="f", labelCol="y", regParam=reg).fit(rows)
        sinks.save_model(model, path)
    again = LinearRegressionModel.load(path)
    assert again.intercept == model.intercept == pytest.approx(1.0) and list(again.coefficients) == list(model.coefficients)


def test_first_present(spark):
    day = lambda n: date(2022, 1, n)
    rows = [(1, day(2), 5.0, None), (1, day(1), None, "b"), (1, day(3), 7.0, "a"), (2, day(1), None, None), (None, day(1), 1.0, None), (3, day(1), 9.0, "z"), (3, day(1), 8.0, "y")]
    got = first_present(spark.createDataFrame(rows, "k int, d date, v double, s string"), ["k"], ["d"])
    assert {r.k: (r.v, r.s) for r in got.collect()} == {1: (5.0, "b"), 2: (None, None), None: (1.0, None), 3: (8.0, "y")}


def test_store():
    local = store({})
    assert local == Store("dev-data", "http://localhost:4566") and local.path("a/", "b.parquet") == "s3a://dev-data/a/b.parquet"
    assert local.settings() == {"spark.hadoop.fs.s3a.bucket.dev-data.endpoint": "http://localhost:4566", "spark.hadoop.fs.s3a.bucket.dev-data.path.style.access": "true", "spark.hadoop.fs.s3a.bucket.dev-data.connection.ssl.enabled": "false"}
    prod = store({"TERRASHIFT_ENV": "prod", "TERRASHIFT_ENDPOINT": "https://store.example", "TERRASHIFT_BUCKET": "x"})
    assert prod.settings()["spark.hadoop.fs.s3a.bucket.x.connection.ssl.enabled"] == "true" and Store("x").settings() == {}
    for bad in ({"TERRASHIFT_ENV": "prod"}, {"TERRASHIFT_ENV": "test"}):
        with pytest.raises(ValueError, match="TERRASHIFT_"):
            store(bad)
