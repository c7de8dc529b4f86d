"""Geometry queries: every customer stands for a polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import geometry as R
from ..operators import spatial as P
from ..operators.batches import spread
from .registry import Tables, query

_point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

# A triangle for each customer, scattered over a square of 400.
_TRIANGLES = "t AS (SELECT c_custkey AS k, c_custkey * 37 % 400 + c_custkey % 9 * 0.5 AS x, CAST(c_custkey * 53 % 400 AS DOUBLE) AS y, CAST(3 + c_custkey % 7 AS DOUBLE) AS s FROM customer), e AS (SELECT k, unnest([{'x1': x, 'y1': y, 'x2': x + s, 'y2': y + 1}, {'x1': x + s, 'y1': y + 1, 'x2': x + 2, 'y2': y + s}, {'x1': x + 2, 'y1': y + s, 'x2': x, 'y2': y}]) AS g FROM t)"


def triangles(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    x, y, s = k * 37 % 400 + k % 9 * 0.5, k * 53 % 400, 3 + k % 7
    return t.customer.select(k.alias("k"), F.array(_point(x, y), _point(x + s, y + 1), _point(x + 2, y + s)).alias("ring"))


@query(
    "SELECT k, CAST(2 AS BIGINT) AS n_parts, round(1.5 * h * h, 6) AS outer_area, round(1.5 * h * h - 4, 6) AS net_area, round((h * h * (x + h / 2) - 4 * (x + 2)) / (h * h - 4), 6) AS cx, round((h * h * (y + h / 2) - 4 * (y + 2)) / (h * h - 4), 6) AS cy, x AS west, x + 500 + h AS east"
    " FROM (SELECT c_custkey AS k, CAST(c_custkey * 37 % 400 AS DOUBLE) AS x, CAST(c_custkey * 53 % 400 AS DOUBLE) AS y, CAST(4 + c_custkey % 7 AS DOUBLE) AS h FROM customer)"
)
def fn_multipolygon(t: Tables) -> DataFrame:
    """A square with a hole and a triangle for each customer: outer rings, their bounds, areas less holes, and the centre of
    the part with the hole."""
    k = F.col("c_custkey")
    x, y, h = k * 37 % 400, k * 53 % 400, 4 + k % 7
    square = lambda a, b, s: F.array(_point(a, b), _point(a + s, b), _point(a + s, b + s), _point(a, b + s))
    triangle = F.array(_point(x + 500, y), _point(x + 500 + h, y), _point(x + 500, y + h))
    made = t.customer.select(k.alias("k"), F.array(F.array(square(x, y, h), square(x + 1, y + 1, F.lit(2))), F.array(triangle)).alias("parts"))
    made = made.withColumn("outer", G.outer_rings(F.col("parts"))).withColumn("first", F.element_at("parts", 1))
    total = lambda rings, f: F.aggregate(F.transform(rings, f), F.lit(0.0), lambda s, v: s + v)
    c, xs = G.polygon_centroid(F.col("first")), F.transform(F.flatten("outer"), lambda p: p["x"])
    return made.select("k", F.size("outer").cast("long").alias("n_parts"), F.round(total("outer", G.area), 6).alias("outer_area"), F.round(total("parts", G.polygon_area), 6).alias("net_area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.array_min(xs).alias("west"), F.array_max(xs).alias("east"))


_SIDE = "sign((a.g.x2 - a.g.x1) * ({y} - a.g.y1) - (a.g.y2 - a.g.y1) * ({x} - a.g.x1))"
_B = "sign((b.g.x2 - b.g.x1) * ({y} - b.g.y1) - (b.g.y2 - b.g.y1) * ({x} - b.g.x1))"
_MEET = (
    f"{_SIDE.format(x='b.g.x1', y='b.g.y1')} * {_SIDE.format(x='b.g.x2', y='b.g.y2')} <= 0 AND {_B.format(x='a.g.x1', y='a.g.y1')} * {_B.format(x='a.g.x2', y='a.g.y2')} <= 0"
    " AND least(a.g.x1, a.g.x2) <= greatest(b.g.x1, b.g.x2) AND least(b.g.x1, b.g.x2) <= greatest(a.g.x1, a.g.x2) AND least(a.g.y1, a.g.y2) <= greatest(b.g.y1, b.g.y2) AND least(b.g.y1, b.g.y2) <= greatest(a.g.y1, a.g.y2)"
)
_HOLDS = "(SELECT sum(CASE WHEN (g.y1 > {o}.y) <> (g.y2 > {o}.y) AND {o}.x < (g.x2 - g.x1) * ({o}.y - g.y1) / (g.y2 - g.y1) + g.x1 THEN 1 ELSE 0 END) % 2 = 1 FROM e WHERE e.k = {s}.k)"


@query(
    f"WITH {_TRIANGLES}, p AS (SELECT t.k AS k1, u.k AS k2 FROM t JOIN t u ON t.k < u.k AND t.x <= u.x + greatest(u.s, 2) AND u.x <= t.x + greatest(t.s, 2) AND t.y <= u.y + u.s AND u.y <= t.y + t.s),"
    f" c AS (SELECT DISTINCT k1, k2 FROM p JOIN e a ON a.k = k1 JOIN e b ON b.k = k2 WHERE {_MEET}), h AS (SELECT k1, k2 FROM p JOIN t ON t.k = k1 JOIN t u ON u.k = k2 WHERE {_HOLDS.format(o='u', s='t')} OR {_HOLDS.format(o='t', s='u')})"
    " SELECT * FROM c UNION SELECT * FROM h"
)
def jn11_polygons_meet(t: Tables) -> DataFrame:
    """Pairs of polygons that share a point; those whose boxes alone meet are not among them."""
    a = triangles(t).select(F.col("k").alias("k1"), F.col("ring").alias("r1"))
    b = triangles(t).select(F.col("k").alias("k2"), F.col("ring").alias("r2"))
    return P.polygons_that_meet(a, b, "r1", "r2", 10.0).filter("k1 < k2").select("k1", "k2")


@query(
    f"WITH {_TRIANGLES}, px AS (SELECT k, c, r, c * 0.5 + 0.25 AS cx, 420 - r * 0.5 - 0.25 AS cy FROM t, LATERAL (SELECT unnest(range(CAST(floor(x * 2) AS BIGINT) - 1, CAST(floor((x + s) * 2) AS BIGINT) + 2)) AS c) a, LATERAL (SELECT unnest(range(CAST(floor((420 - y - s) * 2) AS BIGINT) - 1, CAST(floor((420 - y) * 2) AS BIGINT) + 2)) AS r) b)"
    " SELECT k, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS row_sum, CAST(sum(c) AS BIGINT) AS col_sum FROM (SELECT px.k, c, r FROM px JOIN e ON e.k = px.k GROUP BY 1, 2, 3 HAVING sum(CASE WHEN (g.y1 > cy) <> (g.y2 > cy) AND cx < (g.x2 - g.x1) * (cy - g.y1) / (g.y2 - g.y1) + g.x1 THEN 1 ELSE 0 END) % 2 = 1) GROUP BY 1"
)
def geo11_scanline(t: Tables) -> DataFrame:
    """Pixels of half a unit that each polygon holds."""
    runs = P.filled_pixels(spread(triangles(t), "k"), "ring", 0.0, 420.0, 0.5, -0.5, 1000, 840)
    n = (F.col("last") - F.col("first") + 1).cast("long")
    return runs.groupBy("k").agg(F.sum(n).alias("pixels"), F.sum(n * F.col("row")).alias("row_sum"), F.sum(F.expr("(first + last) * (last - first + 1) div 2")).cast("long").alias("col_sum"))


@query(
    f"WITH {_TRIANGLES}, b AS (SELECT *, x - 0.5 AS w, y - 0.5 AS b, x + greatest(s, 2) + 0.5 AS e, y + s + 0.5 AS n FROM t), p AS (SELECT k, unnest([0, 1, 2]) AS i, unnest([x, x + s, x + 2]) AS px, unnest([y, y + 1, y + s]) AS py, w, b, e, n FROM b)"
    " SELECT k, string_agg(CAST(CAST(round((px - w) / (e - w) * 100, 2) AS DECIMAL(12, 2)) AS VARCHAR) || ',' || CAST(CAST(round((n - py) / (n - b) * 100, 2) AS DECIMAL(12, 2)) AS VARCHAR), ' ' ORDER BY i) AS points FROM p GROUP BY 1"
)
def geo11_svg(t: Tables) -> DataFrame:
    """Polygons as percent coordinates of their padded boxes."""
    return triangles(t).select("k", G.svg_points(F.col("ring"), 0.5).alias("points"))


# A quadrilateral for each customer, whose ring is a bow tie, has a spike, runs twice, or has a hole that touches a side.
_QUADS = "q AS (SELECT c_custkey AS k, c_custkey % 4 AS kind, CAST(c_custkey % 50 * 20 AS DOUBLE) AS x, CAST(c_custkey // 50 * 20 AS DOUBLE) AS y, CAST(9 + c_custkey % 7 AS DOUBLE) AS h FROM customer)"


@query(
    f"WITH {_QUADS}, z AS (SELECT *, h / (2 * h + 3.5) AS u FROM q)"
    # The diagonals of a bow tie part each other as the parallel sides h and h + 3.5 do.
    " SELECT k, CASE kind WHEN 0 THEN 2 ELSE 1 END AS n_rings, round(CASE kind WHEN 0 THEN u * h * h / 2 + (1 - u) * h * (h + 3.5) / 2 WHEN 3 THEN h * (h + 1.75) - 4 ELSE h * (h + 1.75) END, 6) AS area FROM z"
)
def geo05_repair(t: Tables) -> DataFrame:
    """Area and rings of repaired polygons."""
    k = F.col("c_custkey")
    x, y, h = k % 50 * 20, F.floor(k / 50) * 20, k % 7 + 9
    a, b, c, d = _point(x, y), _point(x + h, y), _point(x + h + 3.5, y + h), _point(x, y + h)
    hole = F.array(_point(x, y + 2), _point(x + 2, y + 2), _point(x + 2, y + 4), _point(x, y + 4))
    rings = (
        F.when(k % 4 == 0, F.array(F.array(a, b, d, c))).when(k % 4 == 1, F.array(F.array(a, _point(x + h + 5, y), b, c, d)))
        .when(k % 4 == 2, F.array(F.array(a, b, c, d, a, b, c, d))).otherwise(F.array(F.array(a, b, c, d), hole))
    )
    fixed = R.repair(t.customer.select(k.alias("k"), rings.alias("rings")), "k", "rings")
    return fixed.select("k", F.size("rings").alias("n_rings"), F.round("area", 6).alias("area"))


# A square for each customer on a grid of 40 columns; the middles of borders are moved, for both neighbours alike.
_LOW, _LEFT = "((({i}) * 7 + ({j}) * 3) % 5 * 0.004)", "((({i}) * 3 + ({j}) * 5 + ({j}) * ({i})) % 5 * 0.004)"
_KEPT = "(CASE WHEN {d} > 0.01 THEN {d} ELSE 0 END)"
_KB, _KT, _KL, _KR = (_KEPT.format(d=f.format(i=i, j=j)) for f, i, j in ((_LOW, "i", "j"), (_LOW, "i", "j + 1"), (_LEFT, "i", "j"), (_LEFT, "i + 1", "j")))


@query(
    f"WITH g AS (SELECT c_custkey AS k, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer) SELECT k, CAST(4 + sign({_KB}) + sign({_KT}) + sign({_KL}) + sign({_KR}) AS INTEGER) AS n_points, round(1 + ({_KT} - {_KB} + {_KR} - {_KL}) / 2, 6) AS area FROM g"
)
def geo06_simplify_shared(t: Tables) -> DataFrame:
    """Points and areas of squares with wavy shared borders after simplification."""
    k = F.col("c_custkey")
    i, j = k % 40, F.floor(k / 40)
    low, left = lambda i, j: (i * 7 + j * 3) % 5 * 0.004, lambda i, j: (i * 3 + j * 5 + j * i) % 5 * 0.004
    ring = F.array(
        _point(i, j), _point(i + 0.5, j + low(i, j)), _point(i + 1, j), _point(i + 1 + left(i + 1, j), j + 0.5), _point(i + 1, j + 1), _point(i + 0.5, j + 1 + low(i, j + 1)), _point(i, j + 1), _point(i + left(i, j), j + 0.5),
    )
    thin = R.simplify_shared(t.customer.select(k.alias("k"), ring.alias("ring")), "k", "ring", 0.01, 0.5)
    return thin.select("k", F.size("thin").alias("n_points"), F.round(G.area(F.col("thin")), 6).alias("area"))
