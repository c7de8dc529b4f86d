"""Likeness of two images over pixel tables: structure in sliding windows, and colours as joint histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import bhattacharyya

_SUMS = ("n", "a", "b", "aa", "bb", "ab")


def window_sums(pixels: DataFrame, key: str, columns: tuple[str, ...], size: int) -> DataFrame:
    """Sums of ``columns`` over the size x size window around each pixel; separable, one pass for rows and one for columns."""
    half = size // 2
    for axis, other in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(key, other).orderBy(axis).rangeBetween(-half, half)
        pixels = pixels.select(key, "row", "col", *(F.sum(c).over(w).alias(c) for c in columns))
    return pixels


def structural_similarity(pairs: DataFrame, key: str, size: int = 7, data_range: float = 255.0) -> DataFrame:
    """key, ssim: mean over the windows that lie within the image of two images ``a`` and ``b`` (key, row, col, a, b).

    A window's value is the product of the likeness of means, (2 ma mb + c1) / (ma^2 + mb^2 + c1), and of structure,
    (2 cab + c2) / (ca + cb + c2), with sample covariances. Pixels that lack a value count as missing, and so does every
    window that holds one; an image without a whole window has a null."""
    n = size * size
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    known = a.isNotNull() & b.isNotNull()
    start = pairs.select(key, "row", "col", F.when(known, 1).otherwise(0).alias("n"), *(F.when(known, v).alias(c) for c, v in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))))
    s = window_sums(start, key, _SUMS, size)
    ma, mb = F.col("a") / n, F.col("b") / n
    spread = lambda c, m: (F.col(c) / n - m) * (n / (n - 1))
    value = (2 * ma * mb + c1) * (2 * spread("ab", ma * mb) + c2) / ((ma * ma + mb * mb + c1) * (spread("aa", ma * ma) + spread("bb", mb * mb) + c2))
    return s.groupBy(key).agg(F.avg(F.when(F.col("n") == n, value)).alias("ssim"))


def joint_histogram(pixels: DataFrame, key: str, channels: list[str], bins: int = 16, low: float = 0.0, high: float = 256.0) -> DataFrame:
    """key, ``bin``, ``p``: share of the pixels in each cell of a grid with ``bins`` steps a channel; pixels with a channel
    outside [low, high) are not counted."""
    step = lambda c: F.floor((F.col(c) - low) / (high - low) * bins).cast("long")
    cell, inside = F.lit(0).cast("long"), F.lit(True)
    for c in channels:
        cell, inside = cell * bins + step(c), inside & (F.col(c) >= low) & (F.col(c) < high)
    counts = pixels.filter(inside).groupBy(key, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("all"))
    return counts.join(total, key).select(key, "bin", (F.col("n") / F.col("all")).alias("p"))


def colour_distance(a: DataFrame, b: DataFrame, key: str, channels: list[str], bins: int = 16, low: float = 0.0, high: float = 256.0) -> DataFrame:
    """key, distance of the joint colour histograms of two images (key, and a column a channel)."""
    return bhattacharyya(joint_histogram(a, key, channels, bins, low, high), joint_histogram(b, key, channels, bins, low, high), key)
