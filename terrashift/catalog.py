"""All queries of the library and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, chain, evaluation, geometry, ladders, mart, outputs, raster, rasters, recovery, relational, scalars, series, spatial  # noqa: F401  registers queries
from .plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
