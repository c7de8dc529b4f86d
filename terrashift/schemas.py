"""Fixed schemas of results; ids are strings, months and rates doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COHERENCE_TIMESERIES = (
    "ParcelNo string, pair_idx int, date1 string, date2 string, mid_date string, months_post_fire double, raw_coh double,"
    " costco_coh double, norm_coh double, damage_class string, building_ratio double, used_footprint boolean"
)
PARCEL_CURVATURE = "ParcelNo string, smile_curvature double, vertex_months double, smile_valid boolean, curvature_ci_lower double, curvature_ci_upper double, n_outliers int"
RECOVERY_DETECTION = (
    "ParcelNo string, damage_class string, pre_baseline double, recovery_date timestamp_ntz, recovery_months_post_fire double,"
    " smile_curvature double, vertex_months double, smile_valid boolean, recovery_tau double, recovery_cmin double, recovery_r2 double"
)
LANDSAT_ZONAL = "parcel_idx bigint, observation_date string, dnbr_mean double, dnbr_std double, ndvi_mean double, ndvi_std double, tir_anomaly_mean double, tir_anomaly_std double, swir2_mean double, swir2_std double"
SAR_ZONAL = "parcel_idx bigint, observation_date string, vv_change_db_mean double, vv_change_db_std double, vv_pixel_count bigint, vh_change_db_mean double, vh_change_db_std double, vh_pixel_count bigint"
SERIES_JSON = "array<struct<mid_date string, norm_coh double, smoothed double, months_post_fire double>>"
RECOVERY_BATCH = "array<struct<ParcelNo string, recovery_llm double>>"
PERMITS = "strap string, permit_num string, permit_category string, issue_dt string, estimated_value double, description string, issued_by string"
CROSSWALK = "strap string, Parcelno string"


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds typed null columns for those of ``columns`` (name: type) that are not there."""
    return df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing on the way in: every float column gets nulls instead."""
    floats = {c for c, kind in df.dtypes if kind in ("float", "double")}
    return df.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))
