"""Sinks: Parquet, GeoJSON, a document per key, text batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import merge_first


def parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _renamed(fs, source, target) -> bool:
    return fs.rename(source, target)


def update_in_place(df: DataFrame, path: str) -> None:
    """Overwrite what ``df`` is read from: write beside it, then rename, so a failed write loses nothing; where a rename
    fails, the old table stands again. Between the two renames there is no table at ``path``."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(new)
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(conf)
    there = fs.exists(place(path))
    if there and not _renamed(fs, place(path), place(old)):
        fs.delete(place(new), True)
        raise OSError(f"{path} could not be moved aside; it is unchanged")
    if not _renamed(fs, place(new), place(path)):
        if there and not fs.rename(place(old), place(path)):
            raise OSError(f"{path} could not be replaced: the old table is at {old}, the new one at {new}")
        fs.delete(place(new), True)
        raise OSError(f"{path} could not be replaced; it is unchanged")
    if there:
        fs.delete(place(old), True)


def merge_column(df: DataFrame, extra: DataFrame, key: str, column: str, path: str, order: list[str] | None = None) -> None:
    """Read-modify-write: the old column goes, the new one is joined on, of several rows of a key the first in ``order``
    (without one, of its own values)."""
    update_in_place(merge_first(df.drop(column), extra, key, column, order or [column]), path)


def pixels(df: DataFrame, scene: str, path: str) -> None:
    """Rasters as pixel rows, a folder for each scene; scenes that are there already are left as they are."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        df = df.join(spark.read.parquet(path).select(scene).distinct(), scene, "left_anti")
    df.write.mode("append").partitionBy(scene).parquet(path)


def copy_file(spark, source: str, target: str) -> None:
    """Through the file systems of both, so either may be in any store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf):
        raise OSError(f"{source} could not be copied to {target}")


def save_model(model, path: str) -> None:
    """A fitted model, for the ``load`` of its class."""
    model.write().overwrite().save(path)


def feature(properties: list[str], rings: str) -> Column:
    """A row as GeoJSON feature; nulls stay in the properties."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def geojson_lines(df: DataFrame, properties: list[str], rings: str, path: str) -> None:
    """A feature a line, in as many files as there are partitions: no collection passes through one task."""
    df.select(feature(properties, rings).alias("value")).write.mode("overwrite").text(path)


def json_per_key(df: DataFrame, key: str, order: str, columns: list[str], path: str) -> None:
    """A folder ``key=…`` for each key with its ordered series as one document; nulls kept."""
    point = F.struct(order, *(c for c in columns if c != order))
    docs = df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(point)), {"ignoreNullFields": "false"}).alias("value"))
    docs.write.mode("overwrite").partitionBy(key).text(path)


def text_batches(lines: DataFrame, order: list[str], line: str, size: int, header: str, path: str) -> None:
    """Files ``batch=…`` of ``size`` lines under a header."""
    from ..operators.batches import numbered

    rows = numbered(lines, order, "__n").withColumn("batch", F.floor(F.col("__n") / size))
    bodies = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("__n", line))).alias("l"))
    body = F.concat_ws("\n", F.lit(header), F.transform("l", lambda x: x[line]))
    bodies.select("batch", body.alias("value")).write.mode("overwrite").partitionBy("batch").text(path)
