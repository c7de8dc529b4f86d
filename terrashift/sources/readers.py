"""Scans: CSV with odd headers, GeoJSON, catalogues, file names, incremental reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_in_name
from ..schemas import nan_to_null


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Missing values are null, not NaN; only ``columns`` are read."""
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def optional(spark: SparkSession, path: str, reader=parquet) -> DataFrame | None:
    """None where nothing is there, through Spark's own file system so that any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return reader(spark, path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All strings unless a schema says otherwise: ids keep their zeros."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)


def clean_csv(spark: SparkSession, path: str, keys: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Headers without blanks and quotes, trimmed keys, numbers where they can be read as such."""
    raw = csv(spark, path)
    df = raw.toDF(*(c.strip().strip('"').strip() for c in raw.columns))
    changes = {k: F.btrim(F.btrim(k), F.lit('"')) for k in keys} | {n: F.expr(f"try_cast(`{n}` AS double)") for n in numbers}
    return df.withColumns(changes) if changes else df


GEOMETRY = "type string, coordinates string"


def geojson(spark: SparkSession, path: str, properties: str, parts: bool = False) -> DataFrame:
    """One row per feature: its properties, ``geometry_type`` and ``rings`` (array of rings of points). Of several
    polygons all rings are kept, in order; with ``parts`` the column of that name has them by polygon."""
    schema = f"type string, features array<struct<properties struct<{properties}>, geometry struct<type string, coordinates string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    single = F.from_json(c, "array<array<array<double>>>")
    several = F.from_json(c, "array<array<array<array<double>>>>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(single)).when(F.col("f.geometry.type") == "MultiPolygon", several)
    polygons = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, point)))
    both = [F.flatten(polygons).alias("rings"), polygons.alias("parts")]
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), *both[: 1 + parts])


def properties_only(spark: SparkSession, path: str, properties: str) -> DataFrame:
    return geojson(spark, path, properties).drop("geometry_type", "rings")


def series_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON documents of a folder with the file they are from, in the order of file names."""
    return spark.read.option("multiLine", True).schema(schema).json(glob).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def registry(spark: SparkSession, folders: str) -> DataFrame:
    """path, kind (the folder) and date (from the name) of the raster files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("kind"), date_in_name(F.element_at(F.split("path", "/"), -1)).alias("date"))


def acquisitions(files: DataFrame) -> DataFrame:
    """path and acquisition date from the first time stamp in each name, in order; a file without one is an error."""
    stamp = F.regexp_extract("path", r"_(20\d{6})T\w*Z", 1)
    dated = files.select("path", F.when(stamp == "", F.raise_error(F.concat(F.lit("no time stamp in "), "path")).cast("date")).otherwise(F.to_date(stamp, "yyyyMMdd")).alias("date"))
    return dated.orderBy("date", "path")


def consecutive_pairs(acquired: DataFrame, group: str) -> DataFrame:
    """n - 1 pairs of n acquisitions of each group, in order of date."""
    w = Window.partitionBy(group).orderBy("date", "path")
    pairs = acquired.select(group, F.col("date").alias("date1"), F.col("path").alias("path1"), F.lead("date").over(w).alias("date2"), F.lead("path").over(w).alias("path2"), (F.row_number().over(w) - 1).alias("pair_idx"))
    return pairs.filter("date2 is not null")


def clearest(scenes: DataFrame, month: str, cloud: str, tie: str, limit: float = 10.0) -> DataFrame:
    """Of each month the scene with the least cloud under the limit."""
    w = Window.partitionBy(month).orderBy(cloud, tie)
    return scenes.filter(F.col(cloud) < limit).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_per_date(granules: DataFrame, burst: str, key: Column, time: str) -> DataFrame:
    """Granules of a burst, one for each day: the first by time and name."""
    w = Window.partitionBy(F.substring(time, 1, 10)).orderBy(time, key)
    return granules.filter(key.contains(burst)).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def not_yet(found: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is found and not present."""
    return found.join(present.select(key).distinct(), key, "left_anti")


def pixel_window(pixels: DataFrame, west: float, south: float, east: float, north: float, scene: tuple[str, ...] = ()) -> DataFrame:
    """Pixels within inclusive bounds, rows and columns counted anew from the corner of the window: each scene's own, or
    one for all without ``scene``."""
    inside = pixels.filter(F.col("x").between(west, east) & F.col("y").between(south, north))
    corner = inside.groupBy(*scene).agg(F.min("row").alias("__r"), F.min("col").alias("__c"))
    # Without a scene this is one row; else the scenes' corners, joined by scene.
    joined = inside.join(corner, list(scene)) if scene else inside.join(F.broadcast(corner))
    return joined.withColumn("row", F.col("row") - F.col("__r")).withColumn("col", F.col("col") - F.col("__c")).drop("__r", "__c")


def common_extent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that two chips share, values side by side."""
    return a.select("row", "col", F.col("value").alias("a")).join(b.select("row", "col", F.col("value").alias("b")), ["row", "col"])


def synthetic(spark: SparkSession, parcels: int, dates: list[str], seed: int = 42) -> DataFrame:
    """A row for each parcel and date with seeded noise."""
    base = spark.range(parcels).withColumnRenamed("id", "parcel_id")
    return base.select("parcel_id", F.explode(F.array(*map(F.lit, dates))).alias("observation_date")).withColumns({"vv_change_db": F.randn(seed) * 2 - 1, "ndvi": F.rand(seed + 1), "dnbr": F.rand(seed + 2)})


def grid(spark: SparkSession, west: float, south: float, columns: int, rows: int, step: float = 0.001) -> DataFrame:
    """parcel_id and ring of square cells, row by row from the south-west corner; made by tasks, a range of cells each."""
    x, y = west + (F.col("id") % columns) * step, south + F.floor(F.col("id") / columns) * step
    corner = lambda a, b: F.struct((x + a * step).alias("x"), (y + b * step).alias("y"))
    return spark.range(columns * rows).select(F.col("id").alias("parcel_id"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


def describe(df: DataFrame) -> DataFrame:
    """Name and type of each column, as rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "col_name string, data_type string")
