"""Operators over per-key series: rows (key, idx, value), ordered by idx, dense and without gaps in idx.

Every window is partitioned by the key alone and ordered by idx, so Spark shuffles a series once and evaluates all of
them on that layout. Missing values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 11
SUSTAIN = 5
MAD_SCALE = 1.4826


def frame(key: str, order: str, before: int, after: int):
    return Window.partitionBy(key).orderBy(order).rowsBetween(before, after)


def whole(key: str):
    return Window.partitionBy(key)


def ordered_means(table: DataFrame, keys: dict[str, Column], values: dict[str, Column], counted: str | None = None) -> DataFrame:
    """One row a key with the means of ``values`` and, as ``counted``, its rows, added up in the order of the files' rows.

    A sum of floats depends on its order, in its last digits, and a threshold or a floor behind it makes that another row.
    So partial sums won't do: the rows of a key are sorted (which spills) and added one by one, as a plain scan does.
    ``table`` is read from files, filters allowed."""
    rows = table.select(*(c.alias(k) for k, c in keys.items()), *(c.alias(k) for k, c in values.items()), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__file", "__row")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = rows.select(*keys, *(F.avg(k).over(every).alias(k) for k in values), *([F.count(F.lit(1)).over(every).alias(counted)] if counted else []), F.row_number().over(order).alias("__n"))
    return added.filter("__n = 1").drop("__n")


def dense_grid(rows: DataFrame, key: str, idx: str, low: int, high: int, keys: DataFrame | None = None) -> DataFrame:
    """A row for each key and index in [low, high]; columns of ``rows`` are null where it has none. The index range is
    a small array per key, so this is no cross join."""
    base = (keys if keys is not None else rows.select(key)).distinct()
    grid = base.withColumn(idx, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return grid.join(rows, [key, idx], "left")


def rolling_sum(x: Column, key: str, idx: str, width: int = WIDTH) -> Column:
    """Centred; cut off at the ends; null where nothing in the window is present."""
    return F.sum(x).over(frame(key, idx, -(width // 2), width // 2))


def rolling_count(x: Column, key: str, idx: str, width: int = WIDTH) -> Column:
    return F.count(x).over(frame(key, idx, -(width // 2), width // 2))


def weighted_mean(x: Column, w: Column, key: str, idx: str, width: int = WIDTH) -> Column:
    """Sum of x times w over the sum of w in a centred window; null for no weight."""
    w = F.when(x.isNotNull(), w).otherwise(0.0)
    return F.try_divide(rolling_sum(F.coalesce(x * w, F.lit(0.0)), key, idx, width), rolling_sum(w, key, idx, width))


def interpolate(df: DataFrame, x: str, key: str, idx: str, out: str) -> DataFrame:
    """Linear by row position between present values; ends take the nearest."""
    at = F.when(F.col(x).isNotNull(), F.col("__pos"))
    before, after = frame(key, idx, Window.unboundedPreceding, 0), frame(key, idx, 0, Window.unboundedFollowing)
    placed = df.withColumn("__pos", F.row_number().over(Window.partitionBy(key).orderBy(idx)))
    near = placed.withColumns({"__x0": F.last(x, True).over(before), "__i0": F.last(at, True).over(before), "__x1": F.first(x, True).over(after), "__i1": F.first(at, True).over(after)})
    inside = F.col("__x0") + (F.col("__x1") - F.col("__x0")) * F.try_divide(F.col("__pos") - F.col("__i0"), F.col("__i1") - F.col("__i0"))
    value = F.when(F.col(x).isNotNull(), F.col(x)).when(F.col("__x0").isNull(), F.col("__x1")).when(F.col("__x1").isNull(), F.col("__x0")).otherwise(inside)
    return near.withColumn(out, value).drop("__pos", "__x0", "__i0", "__x1", "__i1")


def wiener(df: DataFrame, x: str, key: str, idx: str, out: str, width: int = WIDTH) -> DataFrame:
    """Local Wiener filter: moments of a zero-padded window, noise as the mean of the local variances."""
    w = frame(key, idx, -(width // 2), width // 2)
    local = df.withColumn("__m", F.sum(x).over(w) / width).withColumn("__v", F.sum(F.col(x) * F.col(x)).over(w) / width - F.col("__m") * F.col("__m"))
    noisy = local.withColumn("__noise", F.avg("__v").over(whole(key)))
    smooth = F.when(F.col("__v") < F.col("__noise"), F.col("__m")).otherwise(F.col("__m") + (F.col(x) - F.col("__m")) * (1 - F.try_divide(F.col("__noise"), F.col("__v"))))
    return noisy.withColumn(out, smooth).drop("__m", "__v", "__noise")


def reject_outliers(df: DataFrame, x: str, key: str, out: str, sigmas: float = 3.0, least: int = 5) -> DataFrame:
    """``out``: x without what lies over ``sigmas`` scaled median absolute deviations from the median; ``__rejected``
    marks those. Under ``least`` values nothing is rejected; a deviation of 0 rejects whatever differs."""
    med = df.withColumn("__med", F.median(x).over(whole(key)))
    dev = med.withColumn("__dev", F.abs(F.col(x) - F.col("__med")))
    spread = dev.withColumn("__mad", F.median("__dev").over(whole(key))).withColumn("__n", F.count(x).over(whole(key)))
    gone = (F.col("__n") >= least) & (F.col("__dev") > sigmas * MAD_SCALE * F.col("__mad"))
    marked = spread.withColumn("__rejected", F.coalesce(gone, F.lit(False)))
    return marked.withColumn(out, F.when(~F.col("__rejected"), F.col(x))).drop("__med", "__dev", "__mad", "__n")


def smooth(df: DataFrame, x: str, key: str, idx: str, out: str, weight: Column | None = None, width: int = WIDTH) -> DataFrame:
    """Outlier rejection, weighted rolling mean, interpolation, Wiener filter, and a mask where the window holds too
    few values. Adds ``out`` and ``n_outliers``. Series that are empty or shorter than the window give nulls."""
    clean = reject_outliers(df, x, key, "__clean")
    clean = clean.withColumn("n_outliers", F.count_if("__rejected").over(whole(key)).cast("int"))
    w = F.lit(1.0) if weight is None else weight
    rolled = clean.withColumn("__roll", weighted_mean(F.col("__clean"), w, key, idx, width))
    filled = interpolate(rolled, "__roll", key, idx, "__fill")
    filtered = wiener(filled, "__fill", key, idx, "__wiener", width)
    few = rolling_count(F.col("__clean"), key, idx, width) < max(1, width // 2)
    short = F.count(F.lit(1)).over(whole(key)) < width
    value = F.when(~few & ~short, F.col("__wiener"))
    return filtered.withColumn(out, value).drop("__clean", "__rejected", "__roll", "__fill", "__wiener")


def display_smooth(df: DataFrame, x: str, key: str, idx: str, out: str, width: int = WIDTH) -> DataFrame:
    """The display's variant: interpolation and Wiener filter alone, over the whole series."""
    return wiener(interpolate(df, x, key, idx, "__fill"), "__fill", key, idx, out, width).drop("__fill")


def sustained_crossing(df: DataFrame, x: str, threshold: Column, key: str, idx: str, skip: Column, sustain: int = SUSTAIN) -> DataFrame:
    """key and ``crossing``: the first index, at ``skip`` or later, from which ``sustain`` values in a row reach the
    threshold; null for none. A null value breaks a run."""
    above = df.withColumn("__above", F.coalesce(F.col(x) >= threshold, F.lit(False)).cast("int"))
    ahead = frame(key, idx, 0, sustain - 1)
    runs = above.withColumn("__run", F.sum("__above").over(ahead))
    start = F.when((F.col("__run") == sustain) & (F.col(idx) >= skip), F.col(idx))
    return runs.groupBy(key).agg(F.min(start).alias("crossing"))


def difference(x: Column, key: str, idx: str) -> Column:
    """From the row before; 0 for the first."""
    return x - F.coalesce(F.lag(x).over(Window.partitionBy(key).orderBy(idx)), x)


def regression_flag(df: DataFrame, x: str, key: str, idx: str) -> DataFrame:
    """key and ``regressed``: whether any value is below the one of the row before; nulls never are."""
    fell = F.col(x) < F.lag(x).over(Window.partitionBy(key).orderBy(idx))
    return df.withColumn("__fell", F.coalesce(fell, F.lit(False))).groupBy(key).agg(F.bool_or("__fell").alias("regressed"))


def reference_normalized(df: DataFrame, x: str, idx: str, is_reference: Column, least: float = 0.01) -> Column:
    """x over the reference's x of the same index; null where that is not above ``least``. The reference is one series,
    a value per index, so a broadcastable aggregate: see ``normalize_by_reference``."""
    ref = F.max(F.when(is_reference, F.col(x))).over(Window.partitionBy(idx))
    return F.when(ref > least, F.col(x) / ref)


def normalize_by_reference(df: DataFrame, x: str, idx: str, is_reference: Column, out: str, least: float = 0.01) -> DataFrame:
    """The join form: one aggregated row per index instead of a window over every key of it."""
    ref = df.filter(is_reference).groupBy(idx).agg(F.max(x).alias("__ref"))
    return df.join(ref, idx, "left").withColumn(out, F.when(F.col("__ref") > least, F.col(x) / F.col("__ref"))).drop("__ref")
