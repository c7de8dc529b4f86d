"""Spatial queries: customers are points, nations quadrilaterals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as P
from .registry import Tables, query

# A quadrilateral for each nation: three upright sides and a slanted one.
_QUAD = "q AS (SELECT n_nationkey, CAST(n_nationkey % 5 * 20 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 20 AS DOUBLE) AS y0, CAST(9 + n_nationkey % 7 AS DOUBLE) AS h FROM nation), e AS (SELECT n_nationkey, unnest([{'x1': x0, 'y1': y0, 'x2': x0 + h, 'y2': y0}, {'x1': x0 + h, 'y1': y0, 'x2': x0 + h + 3.5, 'y2': y0 + h}, {'x1': x0 + h + 3.5, 'y1': y0 + h, 'x2': x0, 'y2': y0 + h}, {'x1': x0, 'y1': y0 + h, 'x2': x0, 'y2': y0}]) AS s FROM q)"
_POINTS = "p AS (SELECT c_custkey, c_acctbal, c_custkey % 100 + 0.25 AS x, (c_custkey * 37) % 100 + 0.25 AS y FROM customer)"
_INSIDE = "i AS (SELECT p.c_custkey, p.c_acctbal, e.n_nationkey, sum(CASE WHEN (s.y1 > y) <> (s.y2 > y) AND x < (s.x2 - s.x1) * (y - s.y1) / (s.y2 - s.y1) + s.x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM p, e GROUP BY 1, 2, 3)"


def quads(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    x, y, h = (k % 5 * 20).cast("double"), (F.floor(k / 5) * 20).cast("double"), (k % 7 + 9).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return t.nation.select("n_nationkey", F.array(point(x, y), point(x + h, y), point(x + h + 3.5, y + h), point(x, y + h)).alias("ring"))


def points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", "c_acctbal", (k % 100 + 0.25).cast("double").alias("x"), ((k * 37) % 100 + 0.25).cast("double").alias("y"))


@query(f"WITH {_QUAD}, {_POINTS}, {_INSIDE} SELECT c_custkey, n_nationkey FROM i WHERE inside")
def jn10_pip(t: Tables) -> DataFrame:
    return P.points_in_polygons(points(t), quads(t), "ring", 20.0).select("c_custkey", "n_nationkey")


@query(f"WITH {_QUAD}, b AS (SELECT n_nationkey AS k, x0 AS w, y0 AS s, x0 + h + 3.5 AS e, y0 + h AS n FROM q) SELECT a.k AS k1, b.k AS k2 FROM b a JOIN b ON a.k < b.k AND a.w - 3 <= b.e + 3 AND b.w - 3 <= a.e + 3 AND a.s - 3 <= b.n + 3 AND b.s - 3 <= a.n + 3")
def jn11_bbox_intersect(t: Tables) -> DataFrame:
    """Pairs of polygons whose buffered boxes meet."""
    boxed = quads(t).select(F.col("n_nationkey").alias("k1"), G.bounds(F.col("ring"), 3.0).alias("b1"))
    other = boxed.select(F.col("k1").alias("k2"), F.col("b1").alias("b2"))
    return P.boxes_that_meet(boxed, other, "b1", "b2", 20.0).filter("k1 < k2").select("k1", "k2")


@query(f"WITH {_QUAD}, {_POINTS}, {_INSIDE} SELECT n_nationkey, CASE WHEN count(*) >= 3 THEN round(avg(c_acctbal), 4) END AS mean, count(*) AS n FROM i WHERE inside GROUP BY 1")
def jn12_zonal(t: Tables) -> DataFrame:
    joined = P.zonal_join(points(t), quads(t), "ring", 20.0)
    return joined.groupBy("n_nationkey").agg(F.when(F.count("*") >= 3, F.round(F.avg("c_acctbal"), 4)).alias("mean"), F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN a = 0 THEN NULL ELSE round(f / a, 6) END AS building_ratio, coalesce(CASE WHEN a <> 0 THEN f / a < 0.8 AND f >= 200 END, false) AS used_footprint FROM (SELECT c_custkey, CAST(c_custkey % 50 * 10 AS DOUBLE) AS a, CAST(c_custkey % 37 * 9 AS DOUBLE) AS f FROM customer)")
def fn_footprint(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ratio, used = G.footprint_choice((k % 37 * 9).cast("double"), (k % 50 * 10).cast("double"))
    return t.customer.select("c_custkey", F.round(ratio, 6).alias("building_ratio"), used.alias("used_footprint"))


@query()
def fn_simplify(t: Tables) -> DataFrame:
    """Rings with a point that lies almost on a side lose it."""
    near = F.transform("ring", lambda p: p)
    dented = quads(t).withColumn("ring", F.concat(F.slice(near, 1, 1), F.array(F.struct((F.col("ring")[0]["x"] + 1).alias("x"), (F.col("ring")[0]["y"] + 1e-6).alias("y"))), F.slice(near, 2, 3)))
    return P.simplify(dented, "ring", 1e-3, "thin").select("n_nationkey", F.size("ring").alias("before"), F.size("thin").alias("after"))
