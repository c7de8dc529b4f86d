"""Session with the settings that every query counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "terrashift", master: str | None = None, shuffle_partitions: int | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """UTC, adaptive execution with skew handling; master and memory come from the cluster unless given. ``settings``: more of
    them, such as a store's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
