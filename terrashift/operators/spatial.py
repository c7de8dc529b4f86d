"""Spatial joins: an equality on grid cells, then the exact predicate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..staging import written
from .batches import spread


def _cells(box, cell: float):
    """Cells that a bounding box touches."""
    xs = F.sequence(F.floor(box["w"] / cell), F.floor(box["e"] / cell))
    ys = F.sequence(F.floor(box["s"] / cell), F.floor(box["n"] / cell))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """Points (x, y, …) with the polygons that hold them. Each polygon is copied to the cells of its box, so ``cell``
    should be near the usual polygon's size."""
    right = polygons.select("*", F.inline(_cells(G.bounds(F.col(ring)), cell)))
    left = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return left.join(right, ["cx", "cy"]).filter(G.contains(F.col(ring), F.col("x"), F.col("y"))).drop("cx", "cy")


def boxes_that_meet(left: DataFrame, right: DataFrame, a: str, b: str, cell: float) -> DataFrame:
    """Pairs of rows whose boxes (struct w, s, e, n) meet. A pair is taken in one cell only: the one that holds the
    lower left corner of what both share."""
    l = left.select("*", F.inline(_cells(F.col(a), cell)))  # noqa: E741
    r = right.select("*", F.inline(_cells(F.col(b), cell)))
    joined = l.join(r, ["cx", "cy"]).filter(G.boxes_overlap(F.col(a), F.col(b)))
    here = (F.floor(F.greatest(F.col(a)["w"], F.col(b)["w"]) / cell) == F.col("cx")) & (F.floor(F.greatest(F.col(a)["s"], F.col(b)["s"]) / cell) == F.col("cy"))
    return joined.filter(here).drop("cx", "cy")


def polygons_that_meet(left: DataFrame, right: DataFrame, a: str, b: str, cell: float) -> DataFrame:
    """Pairs of rows whose rings share a point, borders included: boxes find candidates by cells, each pair once, and the
    exact predicate drops those whose boxes alone meet.

    Cells and predicate are for distinct rings; rows with the same ring then share its pairs by plain joins. These are
    merged, as few bytes of shapes stand for many rows."""
    rings = left.select(F.col(a).alias("__r")).union(right.select(F.col(b).alias("__r"))).filter("__r is not null").distinct()
    shapes = written(rings.withColumn("__id", F.monotonically_increasing_id()), "shapes")
    boxed = spread(shapes.withColumn("__box", G.bounds(F.col("__r"))), "__id", each=500)
    one, two = (boxed.select(*(F.col(f"__{c}").alias(f"__{c}{i}") for c in ("r", "id", "box"))) for i in (1, 2))
    # Of a pair of shapes one order is looked at; the other follows.
    near = boxes_that_meet(one, two.hint("merge"), "__box1", "__box2", cell).filter("__id1 <= __id2").filter(G.rings_meet(F.col("__r1"), F.col("__r2")))
    both = F.array(F.struct(F.col("__id1").alias("__a"), F.col("__id2").alias("__b")), F.struct(F.col("__id2").alias("__a"), F.col("__id1").alias("__b")))
    pairs = written(near.select(F.explode(F.array_distinct(both)).alias("s")).select("s.*"), "shapes-that-meet")
    of = lambda df, ring, out: df.join(shapes.select(F.col("__r").alias(ring), F.col("__id").alias(out)).hint("merge"), ring)
    return of(left, a, "__a").join(pairs.hint("merge"), "__a").join(of(right, b, "__b").hint("merge"), "__b").drop("__a", "__b")


def filled_pixels(polygons: DataFrame, ring: str, x0: float, y0: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """``polygons`` with a row for each run of pixels (row, first, last) that a ring holds; no join with the raster."""
    return polygons.select("*", F.inline(G.fill_runs(F.col(ring), x0, y0, dx, dy, width, height)))


def zonal_join(pixels: DataFrame, polygons: DataFrame, ring: str, cell: float) -> DataFrame:
    """Pixels (row, col, x, y, value) with the polygons that hold their centres."""
    return points_in_polygons(pixels, polygons, ring, cell)


def simplify(ring_rows: DataFrame, ring: str, tolerance: float, out: str) -> DataFrame:
    """``out``: the ring by Douglas and Peucker. A recursive cut, so a vectorised Python function; one ring at a time."""
    kind = ring_rows.schema[ring].dataType

    @F.pandas_udf(kind)
    def cut(rings: pd.Series) -> pd.Series:
        def far(a, b, p):
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            size = (dx * dx + dy * dy) ** 0.5
            return abs(dy * (p["x"] - a["x"]) - dx * (p["y"] - a["y"])) / size if size else ((p["x"] - a["x"]) ** 2 + (p["y"] - a["y"]) ** 2) ** 0.5

        def thin(points):
            if points is None or len(points) < 4:
                return points
            keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
            while todo:
                a, b = todo.pop()
                if b - a < 2:
                    continue
                k = max(range(a + 1, b), key=lambda i: far(points[a], points[b], points[i]))
                if far(points[a], points[b], points[k]) > tolerance:
                    keep.add(k)
                    todo += [(a, k), (k, b)]
            return [points[i] for i in sorted(keep)]

        return rings.map(thin)

    return ring_rows.withColumn(out, cut(ring))
