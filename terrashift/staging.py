"""Tables written in passing: where a plan must not be computed twice, or lineage is to end."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master may do without: executors of a cluster could not see
    each other's files in a machine's own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="terrashift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; ``staged_at`` is its path."""
    spark = df.sparkSession
    # Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def deleted(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing will read it again."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
