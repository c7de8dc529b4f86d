"""Repair, shared simplification, exact intersection and filling of polygons against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terrashift.functions import geo
from terrashift.operators import geometry, spatial

RING = "array<struct<x:double,y:double>>"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def holds(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def points(ring):
    return [(p.x, p.y) for p in ring]


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
STAR = [(math.cos(math.radians(90 + 144 * i)) * 10, math.sin(math.radians(90 + 144 * i)) * 10) for i in range(5)]
SHAPES = {
    "square": ([SQUARE], 16), "clockwise": ([SQUARE[::-1]], 16), "bow tie": ([[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]], 8), "spike": ([[(0.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]], 16),
    "spike across": ([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, -3.0), (2.0, 4.0), (0.0, 4.0)]], 16), "twice": ([SQUARE * 2], 16), "thrice": ([SQUARE * 3], 16), "same ring again": ([SQUARE, SQUARE], 16),
    "hole": ([SQUARE, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]], 15), "hole at a side": ([SQUARE, [(0.0, 1.0), (2.0, 1.0), (2.0, 2.0), (0.0, 2.0)]], 14), "hole beyond": ([SQUARE, [(3.0, 1.0), (5.0, 1.0), (5.0, 2.0), (3.0, 2.0)]], 16),
    "touching itself": ([[(0.0, 0.0), (2.0, 2.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]], 8), "level": ([[(0.0, 0.0), (3.0, 0.0), (1.0, 0.0)]], 0), "a point": ([[(1.0, 1.0)] * 3], 0), "nothing": ([], 0), "empty ring": ([[]], 0),
}


def test_repair(spark):
    rows = [(name, [[{"x": x, "y": y} for x, y in r] for r in rings]) for name, (rings, _) in SHAPES.items()] + [("null", None), ("star", [[{"x": x, "y": y} for x, y in STAR]])]
    r = random.Random(1)
    tangles = {f"tangle {i}": [[(float(r.randint(0, 20)), float(r.randint(0, 20))) for _ in range(r.choice((5, 9, 14)))]] for i in range(12)}
    rows += [(k, [[{"x": x, "y": y} for x, y in ring] for ring in v]) for k, v in tangles.items()]
    got = {x.name: x for x in geometry.repair(spark.createDataFrame(rows, f"name string, rings array<{RING}>"), "name", "rings").collect()}
    assert len(got) == len(rows)
    for name, (_, want) in SHAPES.items():
        assert math.isclose(got[name].area, want, abs_tol=1e-6), name
    assert got["null"].rings == [] and got["null"].area == 0
    # The middle of the star is outside by even-odd, so five points remain.
    assert len(got["star"].rings) == 5 and len(got["bow tie"].rings) == 2 and len(got["hole"].rings) == 2
    assert sorted(area(points(x)) > 0 for x in got["hole"].rings) == [False, True]
    for name, rings in (tangles | {"star": [STAR]}).items():
        made = [points(x) for x in got[name].rings]
        for _ in range(400):
            x, y = r.uniform(-10, 21), r.uniform(-10, 21)
            assert holds(made, x, y) == holds(rings, x, y), name
        # No two sides of the result cross.
        sides = [(a, b) for ring in made for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        for (a, b), (c, d) in itertools.combinations(sides, 2):
            side = lambda p, q, z: (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])
            assert not (side(a, b, c) * side(a, b, d) < -1e-6 and side(c, d, a) * side(c, d, b) < -1e-6), name


def test_shared_borders_stay_shared(spark):
    r = random.Random(3)
    n, steps = 4, 12
    corner = lambda i, j: (i * 10.0, j * 10.0)

    def border(a, b):
        return [(a[0] + (b[0] - a[0]) * t / steps + r.uniform(-0.8, 0.8), a[1] + (b[1] - a[1]) * t / steps + r.uniform(-0.8, 0.8)) for t in range(1, steps)]

    level = {(i, j): border(corner(i, j), corner(i + 1, j)) for i in range(n) for j in range(n + 1)}
    upright = {(i, j): border(corner(i, j), corner(i, j + 1)) for i in range(n + 1) for j in range(n)}
    rings = {}
    for i in range(n):
        for j in range(n):
            ring = [corner(i, j), *level[i, j], corner(i + 1, j), *upright[i + 1, j], corner(i + 1, j + 1), *level[i, j + 1][::-1], corner(i, j + 1), *upright[i, j][::-1]]
            k = r.randrange(len(ring))
            ring = ring[k:] + ring[:k]
            rings[i * n + j] = ring[::-1] if r.random() < 0.5 else ring
    island = [(100 + math.cos(t / 20 * math.tau) * 5, math.sin(t / 20 * math.tau) * 5) for t in range(20)]
    rings |= {50: island, 51: island[7:] + island[:7], 60: [(200.0, 0.0), (201.0, 0.0)]}
    rows = [(k, [{"x": x, "y": y} for x, y in v]) for k, v in rings.items()] + [(70, None), (71, [])]
    got = {x.k: x.thin for x in geometry.simplify_shared(spark.createDataFrame(rows, f"k int, ring {RING}"), "k", "ring", 2.5, 5.0).collect()}
    assert len(got) == len(rows) and got[70] is None and got[71] == [] and points(got[60]) == rings[60]
    thin = {k: points(v) for k, v in got.items() if v}
    # Each inner side is a side of two rings, and the whole keeps its area: neither gaps nor overlaps.
    count = {}
    for k in range(n * n):
        assert len(thin[k]) < len(rings[k]) / 3 and set(thin[k]) <= set(rings[k])
        for a, b in zip(thin[k], thin[k][1:] + thin[k][:1], strict=True):
            count[min(a, b), max(a, b)] = count.get((min(a, b), max(a, b)), 0) + 1
    outer = [s for s, c in count.items() if c == 1]
    assert set(count.values()) <= {1, 2} and len(outer) < len(count)
    outline = geometry.stitch([(a, b) if any((a, b) in zip(x, x[1:] + x[:1], strict=True) for x in (t if area(t) > 0 else t[::-1] for t in (thin[k] for k in range(n * n)))) else (b, a) for a, b in outer])
    assert len(outline) == 1 and math.isclose(abs(area(outline[0])), sum(abs(area(thin[k])) for k in range(n * n)), rel_tol=1e-9)
    assert set(thin[50]) == set(thin[51]) and 3 <= len(thin[50]) < 20


def test_thinning_makes_no_new_crossings(spark):
    # A tooth of the lower border reaches into a fold of the upper one; thinned to straight lines the two would cross.
    upper = [(0.0, 1.0), (4.0, 1.0), (5.0, 1.9), (6.0, 1.0), (10.0, 1.0)]
    lower = [(0.0, 0.0), (4.0, 0.0), (5.0, 1.5), (6.0, 0.0), (10.0, 0.0)]
    rings = {1: upper + [(10.0, 9.0), (0.0, 9.0)], 2: lower[::-1] + [(0.0, -9.0), (10.0, -9.0)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in rings.items()], f"k int, ring {RING}")
    got = {x.k: points(x.thin) for x in geometry.simplify_shared(df, "k", "ring", 1.2, 3.0).collect()}
    assert (5.0, 1.5) in got[2] and (5.0, 1.9) in got[1]
    assert (5.0, 1.9) not in {x.k: points(x.thin) for x in geometry.simplify_shared(df.filter("k = 1"), "k", "ring", 1.2, 3.0).collect()}[1]


def brute_meet(a, b):
    def on(p, q, z):
        return min(p[0], q[0]) <= z[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= z[1] <= max(p[1], q[1])

    def side(p, q, z):
        v = (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])
        return (v > 0) - (v < 0)

    for p, q in zip(a, a[1:] + a[:1], strict=True):
        for s, t in zip(b, b[1:] + b[:1], strict=True):
            d = side(p, q, s), side(p, q, t), side(s, t, p), side(s, t, q)
            if d[0] * d[1] < 0 and d[2] * d[3] < 0 or any(x == 0 and on(*o) for x, o in zip(d, ((p, q, s), (p, q, t), (s, t, p), (s, t, q)), strict=True)):
                return True
    return holds([a], *b[0]) or holds([b], *a[0])


def test_polygons_that_meet(spark):
    r = random.Random(8)
    tri = lambda: [(float(r.randint(0, 30)), float(r.randint(0, 30))) for _ in range(3)]
    shapes = {i: tri() for i in range(60)} | {90: SQUARE, 91: [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], 92: [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0)], 93: [(4.5, 0.0), (5.0, 0.0), (4.5, 9.0), (0.0, 9.0), (0.0, 8.5), (4.4, 8.5)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()], f"k int, ring {RING}")
    a, b = (df.select(F.col("k").alias(f"k{i}"), F.col("ring").alias(f"r{i}")) for i in (1, 2))
    got = [(x.k1, x.k2) for x in spatial.polygons_that_meet(a, b, "r1", "r2", 7.0).filter("k1 < k2").collect()]
    want = {(i, j) for i, j in itertools.combinations(shapes, 2) if brute_meet(shapes[i], shapes[j])}
    assert len(got) == len(set(got)) and set(got) == want
    # The bent one's box holds the square's corner, its ring doesn't.
    assert {(90, 91), (90, 92)} <= want and (90, 93) not in want


def test_fill_equals_points_in_polygon(spark):
    r = random.Random(9)
    shapes = {i: [(r.uniform(-3, 23), r.uniform(-3, 23)) for _ in range(r.choice((3, 4, 7)))] for i in range(40)} | {50: [(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)], 51: [(90.0, 90.0), (99.0, 90.0), (99.0, 99.0)], 52: [], 53: [(2.0, 2.0)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in shapes.items()], f"k int, ring {RING}")
    for x0, y0, dx, dy in ((0.0, 20.0, 1.0, -1.0), (0.5, 0.0, 0.5, 0.75)):
        got = {}
        for x in spatial.filled_pixels(df, "ring", x0, y0, dx, dy, 20, 20).collect():
            for c in range(x.first, x.last + 1):
                assert (x.row, c) not in got.setdefault(x.k, set())
                got[x.k].add((x.row, c))
        for k, ring in shapes.items():
            assert got.get(k, set()) == {(i, j) for i in range(20) for j in range(20) if holds([ring], x0 + (j + 0.5) * dx, y0 + (i + 0.5) * dy)}, k


def test_svg_points(spark):
    df = spark.createDataFrame([([{"x": 10.0, "y": 5.0}, {"x": 18.0, "y": 5.0}, {"x": 18.0, "y": 9.0}],)], f"ring {RING}")
    assert df.select(geo.svg_points(F.col("ring"), 1.0)).first()[0] == "10.00,83.33 90.00,83.33 90.00,16.67"


@pytest.mark.parametrize(("ring", "want"), [([1, 2, 3, 1, 2, 3], 3), ([1, 2, 1, 2, 1], 5), ([1, 1, 1], 1), ([1], 1), ([], 0)])
def test_once(spark, ring, want):
    df = spark.createDataFrame([([{"x": float(v), "y": 0.0} for v in ring],)], f"ring {RING}")
    assert len(df.select(geo.once(F.col("ring"))).first()[0]) == want
