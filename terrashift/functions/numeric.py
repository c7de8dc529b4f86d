"""Band, radar and ratio arithmetic as Column expressions. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale and offset of the imagery products, and the number of looks of the radar product.
REFLECTANCE_SCALE, REFLECTANCE_OFFSET = 2.75e-5, -0.174
TEMPERATURE_SCALE, TEMPERATURE_OFFSET = 0.00341802, 149.0
LOOKS = 25


def clip(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def reflectance(dn: Column) -> Column:
    return clip(dn * REFLECTANCE_SCALE + REFLECTANCE_OFFSET, 0.0, 1.0)


def temperature(dn: Column) -> Column:
    return dn * TEMPERATURE_SCALE + TEMPERATURE_OFFSET


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is zero."""
    return F.try_divide(a - b, a + b)


def safe_ratio(a: Column, b: Column) -> Column:
    """The variant that gives 0 for a zero sum."""
    return F.coalesce(F.try_divide(a - b, a + b), F.lit(0.0))


def burn_difference(pre: Column, post: Column) -> Column:
    """Burn ratio before less after: positive where something burned."""
    return pre - post


def temperature_anomaly(pre: Column, post: Column) -> Column:
    """Temperature after less before."""
    return post - pre


def to_db(x: Column) -> Column:
    """10 log10 x; null for zero and below."""
    return F.when(x > 0, 10 * F.log10(x))


def to_db_floored(x: Column, floor: float = 1e-30) -> Column:
    return F.when(x.isNotNull(), 10 * F.log10(F.greatest(x, F.lit(floor))))


def sigma0_db(dn: Column) -> Column:
    """Calibrated backscatter of a digital number: 10 log10(dn² / 10^8.3)."""
    return F.when(dn > 0, 20 * F.log10(dn) - 83.0)


def touzi_weight(c: Column, looks: int = LOOKS) -> Column:
    """Inverse variance of a coherence estimate, coherence held in [0.01, 0.999]."""
    g = clip(c, 0.01, 0.999)
    return 1 / ((1 - g * g) / (2 * looks * g * g))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Percentile stretch onto [0, 1]."""
    return clip(F.try_divide(x - low, high - low), 0.0, 1.0)


def recovery_ratio(now: Column, post: Column, pre: Column) -> Column:
    """(now - post) / (pre - post) in [0, 2]; 1 where pre and post are closer than 1e-6."""
    return F.when(F.abs(pre - post) <= 1e-6, F.lit(1.0)).otherwise(clip(F.try_divide(now - post, pre - post), 0.0, 2.0))


def texture_ratio(now: Column, pre: Column) -> Column:
    return F.when(pre <= 1e-6, F.lit(1.0)).otherwise(clip(F.try_divide(now, pre), 0.0, 1.0))


def conj_multiply(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    """First times the conjugate of the second."""
    return re1 * re2 + im1 * im2, im1 * re2 - re1 * im2


def json_safe(x: Column, places: int = 4) -> Column:
    """Rounded, with NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, places))


def zero_to_null(x: Column) -> Column:
    """Zero reads as missing where a value is tested for truth."""
    return F.nullif(x, F.lit(0.0))


def mean_of_present(*xs: Column) -> Column:
    """Mean over the columns that are not null."""
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    return F.try_divide(total, sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int")))


def js_round(x: Column) -> Column:
    """Half up towards plus infinity."""
    return F.floor(x + 0.5)
