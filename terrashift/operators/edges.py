"""Edges of images by gradient, suppression along its direction and hysteresis, over pixel tables (key, row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written
from .graph import components

_LOW_ANGLE, _HIGH_ANGLE = math.tan(math.pi / 8), math.tan(3 * math.pi / 8)


def beside(pixels: DataFrame, key: str, axis: str, columns: list[str]) -> DataFrame:
    """Adds ``c_before`` and ``c_after``, the values one place before and after along ``axis``; null where there is none."""
    other = "col" if axis == "row" else "row"
    w = Window.partitionBy(key, other).orderBy(axis)
    held = F.struct(axis, *columns)
    both = pixels.withColumns({"__b": F.lag(held).over(w), "__a": F.lead(held).over(w)})
    near = {f"{c}_{name}": F.when(F.col(f"{s}.{axis}") == F.col(axis) + step, F.col(f"{s}.{c}")) for c in columns for name, s, step in (("before", "__b", -1), ("after", "__a", 1))}
    return both.withColumns(near).drop("__b", "__a")


def gradients(pixels: DataFrame, key: str) -> DataFrame:
    """key, row, col, gx, gy by the 3 x 3 Sobel stencils; beyond a border the border pixel stands."""
    or_own = lambda c, side: F.coalesce(f"{c}_{side}", c)
    across = beside(pixels.select(key, "row", "col", "value"), key, "col", ["value"])
    left, right = or_own("value", "before"), or_own("value", "after")
    lines = across.select(key, "row", "col", (right - left).alias("dx"), (left + 2 * F.col("value") + right).alias("sx"))
    down = beside(lines, key, "row", ["dx", "sx"])
    return down.select(key, "row", "col", (or_own("dx", "before") + 2 * F.col("dx") + or_own("dx", "after")).alias("gx"), (or_own("sx", "after") - or_own("sx", "before")).alias("gy"))


def ridges(pixels: DataFrame, key: str, low: float) -> DataFrame:
    """key, row, col, ``m`` = |gx| + |gy| of pixels above ``low`` that no neighbour along the gradient exceeds; of two equal
    ones side by side, or one above the other, the second stays out of it."""
    steep = gradients(pixels, key).withColumn("m", F.abs("gx") + F.abs("gy"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wide = beside(steep, key, "col", ["m"]).withColumns({"l": zero("m_before"), "r": zero("m_after")}).drop("m_before", "m_after")
    high = beside(wide, key, "row", ["l", "m", "r"])
    m, x, y = F.col("m"), F.abs("gx"), F.abs("gy")
    level = (m > F.col("l")) & (m >= F.col("r"))
    upright = (m > zero("m_before")) & (m >= zero("m_after"))
    falling, rising = (m > zero("l_before")) & (m > zero("r_after")), (m > zero("r_before")) & (m > zero("l_after"))
    top = F.when(y < _LOW_ANGLE * x, level).when(y > _HIGH_ANGLE * x, upright).when((F.col("gx") < 0) != (F.col("gy") < 0), rising).otherwise(falling)
    return high.filter((m > low) & top).select(key, "row", "col", "m")


def canny(pixels: DataFrame, key: str, low: float = 50.0, high: float = 150.0) -> DataFrame:
    """key, row, col of edge pixels: ridges above ``high``, and those above ``low`` that hang together with one, corners
    included. Stretches of a line are the nodes of the graph, so a long edge costs few rounds."""
    w = Window.partitionBy(key, "row")
    order = w.orderBy("col")
    found = ridges(pixels, key, low).withColumn("__g", F.col("col") - F.row_number().over(order))
    start = F.min("col").over(Window.partitionBy(key, "row", "__g"))
    strong = written(found.select(key, "row", "col", (F.col("m") > high).alias("strong"), F.struct(F.col(key).alias("k"), F.col("row").alias("r"), start.alias("c")).alias("node")), "canny-ridges")
    below = strong.select(key, (F.col("row") + 1).alias("row"), F.explode(F.array(*(F.col("col") + d for d in (-1, 0, 1)))).alias("col"), F.col("node").alias("above"))
    joined = components(strong.join(below, [key, "row", "col"]).select("above", "node").distinct(), "above", "node")
    nodes = strong.groupBy("node").agg(F.max("strong").alias("strong")).join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = nodes.groupBy("root").agg(F.max("strong").alias("any")).filter("any").select("root").join(nodes, "root").select("node")
    return strong.join(kept, "node", "left_semi").select(key, "row", "col")
