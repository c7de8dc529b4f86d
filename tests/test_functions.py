import math

import pytest
from pyspark.sql import functions as F

from terrashift.functions import classify, dates, geo, numeric


def value(spark, column, **row):
    rows = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) or v is None else 'string'}" for k, v in row.items()))
    return rows.select(column.alias("v")).first().v


@pytest.mark.parametrize(("dn", "want"), [(10000.0, 0.101), (0.0, 0.0), (50000.0, 1.0), (None, None)])
def test_reflectance(spark, dn, want):
    got = value(spark, numeric.reflectance(F.col("dn")), dn=dn)
    assert got is None if want is None else abs(got - want) < 1e-3


def test_temperature(spark):
    assert abs(value(spark, numeric.temperature(F.col("dn")), dn=50000.0) - 319.901) < 0.01


@pytest.mark.parametrize(("a", "b", "want"), [(0.5, 0.3, 0.25), (0.0, 0.0, None), (0.3, 0.3, 0.0)])
def test_normalized_difference(spark, a, b, want):
    got = value(spark, numeric.normalized_difference(F.col("a"), F.col("b")), a=a, b=b)
    assert got == pytest.approx(want) if want is not None else got is None
    assert value(spark, numeric.safe_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want or 0.0)


@pytest.mark.parametrize(("x", "want"), [(1.0, 0.0), (0.1, -10.0), (0.01, -20.0), (0.0, None)])
def test_to_db(spark, x, want):
    got = value(spark, numeric.to_db(F.col("x")), x=x)
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("x", "want"), [(3.14159, 3.1416), (None, None), (float("nan"), None), (float("inf"), None)])
def test_json_safe(spark, x, want):
    assert value(spark, numeric.json_safe(F.col("x")), x=x) == want


def test_ratios(spark):
    assert value(spark, numeric.recovery_ratio(F.lit(0.5), F.lit(0.2), F.lit(0.8)), x=0.0) == pytest.approx(0.5)
    assert value(spark, numeric.recovery_ratio(F.lit(0.5), F.lit(0.2), F.lit(0.2)), x=0.0) == 1.0
    assert value(spark, numeric.texture_ratio(F.lit(5.0), F.lit(2.0)), x=0.0) == 1.0
    assert value(spark, numeric.mean_of_present(F.lit(None).cast("double"), F.lit(4.0)), x=0.0) == 4.0
    assert value(spark, numeric.mean_of_present(F.lit(None).cast("double"), F.lit(None).cast("double")), x=0.0) is None
    assert value(spark, numeric.js_round(F.lit(-2.5)), x=0.0) == -2


@pytest.mark.parametrize(("x", "want"), [(0.7, "high_severity"), (0.44, "moderate_high_severity"), (0.27, "moderate_low_severity"), (0.1, "low_severity"), (0.09, "unburned"), (None, "unburned")])
def test_severity(spark, x, want):
    assert value(spark, classify.burn_severity(F.col("x")), x=x) == want


@pytest.mark.parametrize(("x", "want"), [(-2.0, "moderate_loss"), (-4.0, "moderate_loss"), (-4.1, "severe_loss"), (0.0, "minimal_change"), (None, "unknown")])
def test_sar_change(spark, x, want):
    assert value(spark, classify.sar_change(F.col("x")), x=x) == want


@pytest.mark.parametrize(("text", "want"), [("DEMOLITION then foundation", "cleared_lot"), ("Framing", "structure_substantial"), ("Foundation final", "foundation_framing"), ("COO", "rebuild_complete"), ("New SFR", "rebuild_start"), ("none", "other"), (None, "unknown")])
def test_permit_stage(spark, text, want):
    assert value(spark, classify.permit_stage(F.col("t")), t=text) == want


def test_dates(spark):
    assert str(value(spark, dates.parse_us_timestamp(F.lit("1/5/2022 3:04:05 PM")), x=0.0)) == "2022-01-05 15:04:05"
    assert value(spark, dates.parse_us_timestamp(F.lit("soon")), x=0.0) is None
    noon = F.lit("2021-12-25 12:00:00").cast("timestamp")
    assert value(spark, dates.whole_days(F.lit("2021-12-30").cast("date"), noon), x=0.0) == -5
    low, high = dates.month_range(F.lit("2021-12"))
    assert str(value(spark, high, x=0.0)) == "2022-01-01" and str(value(spark, low, x=0.0)) == "2021-12-01"
    assert value(spark, dates.date_in_name(F.lit("dnbr_202206.tif")), x=0.0) == "2022-06"


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_geometry(spark):
    shape = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    assert value(spark, geo.area(shape), x=0.0) == pytest.approx(10.0)
    assert value(spark, geo.contains(shape, F.lit(2.0), F.lit(0.5)), x=0.0) is True
    assert value(spark, geo.contains(shape, F.lit(2.0), F.lit(3.0)), x=0.0) is False
    c = value(spark, geo.centroid(geo.box(0, 0, 4, 2)), x=0.0)
    assert (c.x, c.y) == pytest.approx((2.0, 1.0))


def test_utm(spark):
    e, n = geo.utm(F.lit(-105.0), F.lit(40.0), 13)
    assert value(spark, e, x=0.0) == pytest.approx(500_000.0, abs=1e-3)
    # Meridian arc to 40 degrees north times the scale on the central meridian.
    assert value(spark, n, x=0.0) == pytest.approx(4_427_757.22, abs=1.0)


def test_mercator_round_trip(spark):
    px, py = geo.mercator_pixel(F.lit(-105.2), F.lit(39.95), 17)
    lon, lat = geo.mercator_degrees(px, py, 17)
    assert value(spark, lon, x=0.0) == pytest.approx(-105.2) and value(spark, lat, x=0.0) == pytest.approx(39.95)
    assert not math.isnan(value(spark, py, x=0.0))
