"""Plane and map geometry over ring arrays: array<struct<x double, y double>>, first point not repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of each side."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Centre of area; null for a ring without area."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    sx = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] + e["x2"]) * cross(e))
    sy = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["y1"] + e["y2"]) * cross(e))
    a = 6 * signed_area(ring)
    return F.struct(F.try_divide(sx, a).alias("x"), F.try_divide(sy, a).alias("y"))


def polygon_area(rings: Column) -> Column:
    """Of the first ring less the others, its holes; zero for a polygon without rings."""
    part = lambda r, i: F.when(i == 0, area(r)).otherwise(-area(r))
    return F.aggregate(F.transform(rings, part), F.lit(0.0), lambda s, v: s + v)


def polygon_centroid(rings: Column) -> Column:
    """Centre of the first ring less the others, its holes; null for a polygon without area. Rings without area count nothing."""

    def moment(c: str) -> Column:
        part = lambda r, i: F.coalesce(F.when(i == 0, area(r)).otherwise(-area(r)) * centroid(r)[c], F.lit(0.0))
        return F.try_divide(F.aggregate(F.transform(rings, part), F.lit(0.0), lambda s, v: s + v), polygon_area(rings))

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def outer_rings(parts: Column) -> Column:
    """The first ring of each polygon of several; polygons without rings are left out."""
    return F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: p[0])


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Crossing parity of a ray to the right."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"], F.lit(False))
    return F.aggregate(_edges(ring), F.lit(False), lambda inside, e: inside != crosses(e))


def bounds(ring: Column, buffer: float = 0.0) -> Column:
    pick = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct((pick(F.array_min, "x") - buffer).alias("w"), (pick(F.array_min, "y") - buffer).alias("s"), (pick(F.array_max, "x") + buffer).alias("e"), (pick(F.array_max, "y") + buffer).alias("n"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def box(w: float, s: float, e: float, n: float) -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n))))


def footprint_choice(footprint_area: Column, parcel_area: Column, max_ratio: float = 0.8, min_area: float = 200.0) -> tuple[Column, Column]:
    """Share of the parcel that is built on, and whether the footprint stands for the parcel (false for null)."""
    ratio = F.try_divide(footprint_area, parcel_area)
    return ratio, F.coalesce((ratio < max_ratio) & (footprint_area >= min_area), F.lit(False))


def mercator_pixel(lon: Column, lat: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    n = tile * 2**zoom
    r = F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n


def mercator_degrees(px: Column, py: Column, zoom: int, tile: int = 256) -> tuple[Column, Column]:
    n = tile * 2**zoom
    return px / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * py / n))))


# Fixed values of the WGS84 ellipsoid and the UTM projection.
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on the northern half, by the series in the third flattening (to about a millimetre)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - ecc * atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + K0 * radius * east, K0 * radius * north


def pixel_center(x0: Column, dx: Column, col: Column) -> Column:
    """Centre of a column when x0 is the left edge of the first."""
    return x0 + (col + 0.5) * dx


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments (struct x1, y1, x2, y2) share a point, ends included: their boxes meet and neither lies on one
    side of the other."""
    side = lambda s, x, y: (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
    apart = lambda s, t: F.signum(side(s, t["x1"], t["y1"])) * F.signum(side(s, t["x2"], t["y2"])) > 0
    reach = lambda s, t, c: (F.least(s[f"{c}1"], s[f"{c}2"]) <= F.greatest(t[f"{c}1"], t[f"{c}2"])) & (F.least(t[f"{c}1"], t[f"{c}2"]) <= F.greatest(s[f"{c}1"], s[f"{c}2"]))
    return reach(a, b, "x") & reach(a, b, "y") & ~apart(a, b) & ~apart(b, a)


def rings_meet(a: Column, b: Column) -> Column:
    """Whether the areas of two rings share a point: sides meet, or one holds the other."""
    crossed = F.exists(_edges(a), lambda s: F.exists(_edges(b), lambda t: segments_meet(s, t)))
    return crossed | contains(a, b[0]["x"], b[0]["y"]) | contains(b, a[0]["x"], a[0]["y"])


def fill_runs(ring: Column, x0: float, y0: float, dx: float, dy: float, width: int, height: int) -> Column:
    """Runs (row, first, last) of the pixels whose centres a ring holds, by even-odd crossings of each row's centre line.

    The raster has its corner at (x0, y0), steps dx > 0 and dy (negative where north is up), and ``width`` by ``height``
    pixels. A row costs its crossings, whatever the number of its pixels."""
    ys = F.transform(ring, lambda p: (p["y"] - y0) / dy)
    rows = F.sequence(F.greatest(F.floor(F.array_min(ys)), F.lit(0)).cast("int"), F.least(F.floor(F.array_max(ys)), F.lit(height - 1)).cast("int"))
    rows = F.when((F.array_max(ys) >= 0) & (F.array_min(ys) < height) & (F.size(ring) > 2), rows).otherwise(F.expr("cast(array() as array<int>)"))

    def of_row(r: Column) -> Column:
        y = F.lit(y0) + (r + 0.5) * dy
        cut = F.filter(_edges(ring), lambda e: (e["y1"] > y) != (e["y2"] > y))
        xs = F.array_sort(F.transform(cut, lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
        # The first column whose centre isn't left of a crossing.
        cols = F.transform(xs, lambda x: F.ceil((x - x0) / dx - 0.5))
        pairs = F.transform(F.sequence(F.lit(1), F.size(cols) - 1, F.lit(2)), lambda i: F.struct(r.alias("row"), F.greatest(F.element_at(cols, i), F.lit(0)).cast("int").alias("first"), F.least(F.element_at(cols, i + 1) - 1, F.lit(width - 1)).cast("int").alias("last")))
        return F.when(F.size(cols) > 1, F.filter(pairs, lambda p: p["first"] <= p["last"])).otherwise(F.expr("cast(array() as array<struct<row:int,first:int,last:int>>)"))

    return F.flatten(F.transform(rows, of_row))


def svg_points(ring: Column, pad: float, digits: int = 2) -> Column:
    """A ring's points in percent of its padded box from the upper left, as the ``points`` of an SVG polygon."""
    b = bounds(ring, pad)
    text = lambda v: F.round(v, digits).cast(f"decimal(12,{digits})").cast("string")
    return F.array_join(F.transform(ring, lambda p: F.concat(text((p["x"] - b["w"]) / (b["e"] - b["w"]) * 100), F.lit(","), text((b["n"] - p["y"]) / (b["n"] - b["s"]) * 100))), " ")


def once(ring: Column) -> Column:
    """A ring that runs over the same points several times, once."""
    n = F.size(ring)
    turns = F.filter(F.sequence(F.lit(1), n), lambda p: (n % p == 0) & F.when(n % p == 0, F.concat(F.slice(ring, p + 1, n - p + 1), F.slice(ring, F.lit(1), p)) == ring).otherwise(False))
    return F.when(n > 1, F.slice(ring, F.lit(1), turns[0])).otherwise(ring)
