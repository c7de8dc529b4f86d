"""Month and date arithmetic with the domain's constant month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_DAYS = 30.44


def parse_us_timestamp(text: Column) -> Column:
    """Month/day/year with a twelve-hour clock; what can't be read is null."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm:ss a"))


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, rounded down."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000)


def months_between(start: Column, end: Column, places: int = 2) -> Column:
    return F.round(whole_days(start, end) / MONTH_DAYS, places)


def midpoint(start: Column, end: Column) -> Column:
    a, b = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    return F.timestamp_micros(a + F.floor((b - a) / 2))


def add_months_constant(start: Column, months: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + F.round(months * MONTH_DAYS * 86_400_000_000).cast("long"))


def month_range(month: Column) -> tuple[Column, Column]:
    """Half-open range of a yyyy-MM month."""
    first = F.to_date(F.concat(month, F.lit("-01")))
    return first, F.add_months(first, 1)


def year_share(day: Column) -> Column:
    return F.dayofyear(day) / 365


def date_in_name(name: Column) -> Column:
    """yyyy-MM or yyyyMM in a file's name, with a hyphen; unknown where there is none."""
    found = F.regexp_extract(name, r"(20\d{2}[-_]?\d{2})", 1)
    return F.when(found == "", "unknown").otherwise(F.concat(F.substring(found, 1, 4), F.lit("-"), F.substring(found, -2, 2)))
