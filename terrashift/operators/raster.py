"""Raster operators over pixel tables: a row for each (scene, row, col)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_pixels(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """A flat array per row as pixels: key, row, col, value."""
    exploded = df.select(key, F.posexplode(values).alias("__p", "value"))
    return exploded.select(key, F.floor(F.col("__p") / width).cast("int").alias("row"), (F.col("__p") % width).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def _reflect(i: Column, n: int) -> Column:
    """Half-sample symmetric border: … 1 0 | 0 1 2 … n-1 | n-1 n-2 …"""
    return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)


def box_mean(pixels: DataFrame, key: str, columns: list[str], height: int, width: int, size: int = 5) -> DataFrame:
    """Mean of each column over a size x size window with reflected borders. Separable: each pass sends a pixel to the
    ``size`` targets of its line that read it, then averages by target."""
    half = size // 2
    for axis, n in (("row", height), ("col", width)):
        other = "col" if axis == "row" else "row"
        # A target reads source reflect(target + d): each source goes to all targets for which that holds.
        near = F.sequence(F.greatest(F.col(axis) - 2 * half, F.lit(0)), F.least(F.col(axis) + 2 * half, F.lit(n - 1)))
        times = lambda target: sum((F.when(_reflect(target + d, n) == F.col(axis), 1).otherwise(0) for d in range(-half + 1, half + 1)), F.when(_reflect(target - half, n) == F.col(axis), 1).otherwise(0))  # noqa: E731, B023
        sent = pixels.withColumn("__t", F.explode(near)).withColumn("__n", times(F.col("__t"))).filter("__n > 0")
        pixels = sent.groupBy(key, F.col("__t").alias(axis), other).agg(*((F.sum(F.col(c) * F.col("__n")) / F.lit(float(size))).alias(c) for c in columns))
    return pixels.select(key, "row", "col", *columns)


def coherence(pairs: DataFrame, key: str, height: int, width: int, size: int = 5) -> DataFrame:
    """key, row, col, coherence of two complex images (re1, im1, re2, im2): |mean(s1 s2*)| over the root of the mean
    powers. Missing samples count as zero in the means and are null in the result; no power gives 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    made = pairs.select(
        key, "row", "col", (z("re1") * z("re2") + z("im1") * z("im2")).alias("cr"), (z("im1") * z("re2") - z("re1") * z("im2")).alias("ci"), (z("re1") * z("re1") + z("im1") * z("im1")).alias("p1"), (z("re2") * z("re2") + z("im2") * z("im2")).alias("p2"),
    )
    means = box_mean(made, key, ["cr", "ci", "p1", "p2"], height, width, size)
    power = F.sqrt(F.col("p1") * F.col("p2"))
    value = F.when(power > 0, F.hypot("cr", "ci") / power).otherwise(0.0)
    valid = pairs.select(key, "row", "col", (F.col("re1").isNotNull() & F.col("im1").isNotNull() & F.col("re2").isNotNull() & F.col("im2").isNotNull()).alias("ok"))
    return means.join(valid, [key, "row", "col"]).select(key, "row", "col", F.when(F.col("ok"), value).alias("coherence"))


def zonal(pixels: DataFrame, zone: list[str], value: str = "value", least: int = 1) -> DataFrame:
    """Mean, population deviation, min, max, range, median and count by zone; all but the count are null under
    ``least`` pixels."""
    v = F.col(value)
    n = F.count(v)
    gate = lambda x: F.when(n >= least, x)
    return pixels.groupBy(*zone).agg(gate(F.avg(v)).alias("mean"), gate(F.stddev_pop(v)).alias("std"), gate(F.min(v)).alias("lo"), gate(F.max(v)).alias("hi"), gate(F.max(v) - F.min(v)).alias("spread"), gate(F.median(v)).alias("med"), n.alias("n"))


def laplacian(pixels: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """key, row, col, laplacian by the four-neighbour stencil; neighbours beyond the border reflect about the edge
    pixel. Each pixel goes to its neighbours and itself, and sums settle it."""
    sends = F.array(
        F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.lit(-4).alias("k")),
        *(F.struct((F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c"), F.lit(1).alias("k")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))),
        # The pixel one in from a border also stands for the one that is missing beyond it.
        F.struct(F.when(F.col("row") == 1, 0).alias("r"), F.col("col").alias("c"), F.lit(1).alias("k")),
        F.struct(F.when(F.col("row") == height - 2, height - 1).alias("r"), F.col("col").alias("c"), F.lit(1).alias("k")),
        F.struct(F.col("row").alias("r"), F.when(F.col("col") == 1, 0).alias("c"), F.lit(1).alias("k")),
        F.struct(F.col("row").alias("r"), F.when(F.col("col") == width - 2, width - 1).alias("c"), F.lit(1).alias("k")),
    )
    sent = pixels.select(key, "value", F.inline(sends)).filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    return sent.groupBy(key, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("k") * F.col("value")).alias("laplacian"))


def entropy(pixels: DataFrame, key: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """key, entropy in bits of a histogram of equal bins over [low, high]; the last bin takes the upper end."""
    at = F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1))
    counts = pixels.filter(F.col("value").between(low, high)).groupBy(key, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Sum of n log n per key gives the entropy without the total of the key at hand.
    return counts.groupBy(key).agg((F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def bhattacharyya(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, distance sqrt(1 - sum sqrt(p q)) of two histograms (key, bin, p), each with sum 1."""
    q = b.select(key, "bin", F.col("p").alias("q"))
    return a.join(q, [key, "bin"], "full").groupBy(key).agg(F.sqrt(F.greatest(1 - F.sum(F.sqrt(F.coalesce("p", F.lit(0.0)) * F.coalesce("q", F.lit(0.0)))), F.lit(0.0))).alias("distance"))
