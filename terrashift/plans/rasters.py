"""Raster files and image features: embeddings are blocks of 8 x 8 pixels, laid side by side in three scenes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import edges as E
from ..operators import raster as R
from ..operators import similarity as L
from ..operators import stages as S
from ..sources import geotiff as G
from ..staging import shared_dir
from .registry import Tables, query

#: Blocks in a line of a scene.
ACROSS = 8
_SCENES = (
    f"px AS (SELECT vec_id % 3 AS scene, CAST(vec_id // 3 // {ACROSS} * 8 + i // 8 AS INTEGER) AS \"row\", CAST(vec_id // 3 % {ACROSS} * 8 + i % 8 AS INTEGER) AS col, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)), "
    "g AS (SELECT scene, \"row\", col, 100.0 * scene + col + 0.5 AS x, 1000.0 - 5 * scene - \"row\" - 0.5 AS y, value FROM px)"
)


def scene_pixels(t: Tables) -> DataFrame:
    k = F.floor(F.col("vec_id") / 3)
    px = R.to_pixels(t.embeddings, "vec_id", "embedding", 8)
    return px.select((F.col("vec_id") % 3).alias("scene"), (F.floor(k / ACROSS) * 8 + F.col("row")).cast("int").alias("row"), (k % ACROSS * 8 + F.col("col")).cast("int").alias("col"), "value")


def scene_profiles(t: Tables) -> DataFrame:
    k = F.floor(F.col("vec_id") / 3)
    sizes = t.embeddings.groupBy((F.col("vec_id") % 3).alias("scene")).agg(((F.floor(F.max(k) / ACROSS) + 1) * 8).cast("int").alias("height"))
    return sizes.select("scene", F.lit(8 * ACROSS).alias("width"), "height", (100.0 * F.col("scene")).alias("x0"), (1000.0 - 5 * F.col("scene")).alias("y0"), F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy"), F.lit(32613).alias("epsg"))


def scene_files(t: Tables) -> str:
    """The scenes as GeoTIFF files in a folder of their own."""
    folder = f"{shared_dir(t.spark)}/rasters-{uuid.uuid4().hex}"
    G.write(scene_pixels(t), scene_profiles(t), folder, tile=32)
    return folder


@query(f"WITH {_SCENES} SELECT * FROM g")
def src09_raster_file(t: Tables) -> DataFrame:
    """Every pixel with a value, written to files and read from them."""
    pixels = G.read(t.spark, scene_files(t)).filter("value is not null")
    return pixels.select(F.col("scene").cast("long").alias("scene"), "row", "col", "x", "y", F.col("value").cast("double").alias("value"))


@query(f"WITH {_SCENES}, i AS (SELECT * FROM g WHERE x BETWEEN 40 AND 220 AND y BETWEEN 960.5 AND 988.5) SELECT scene, CAST(\"row\" - min(\"row\") OVER w AS INTEGER) AS \"row\", CAST(col - min(col) OVER w AS INTEGER) AS col, x, y, value FROM i WINDOW w AS (PARTITION BY scene)")
def src10_raster_window(t: Tables) -> DataFrame:
    """A window on the map: tiles outside are not fetched, and each scene counts from its own corner."""
    pixels = G.read(t.spark, scene_files(t)).filter("value is not null")
    inside = G.window(pixels, 40.0, 960.5, 220.0, 988.5)
    return inside.select(F.col("scene").cast("long").alias("scene"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "x", "y", F.col("value").cast("double").alias("value"))


@query(f"WITH {_SCENES} SELECT scene, 64 AS width, CAST(max(\"row\") // 8 * 8 + 8 AS INTEGER) AS height, 1 AS bands, 100.0 * scene AS x0, 1000.0 - 5 * scene AS y0, 1.0 AS dx, -1.0 AS dy, 32613 AS epsg, 'float32' AS dtype FROM px GROUP BY 1")
def snk06_profiles(t: Tables) -> DataFrame:
    """What the written files' headers say."""
    rows = G.profiles(t.spark, scene_files(t))
    return rows.select(F.col("scene").cast("long").alias("scene"), "width", "height", "bands", "x0", "y0", "dx", "dy", "epsg", "dtype")


_GRAY = "px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, least(greatest(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255), 0), 255) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"
# Sobel sums over neighbours clamped to the image; then the magnitudes of the neighbours, 0 beyond it.
_CANNY = f"""
WITH RECURSIVE {_GRAY}, o AS (SELECT a.d AS dr, b.d AS dc FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b),
g AS (
  SELECT p.vec_id, p.r, p.c, sum(q.v * dc * (2 - abs(dr))) AS gx, sum(q.v * dr * (2 - abs(dc))) AS gy
  FROM px p, o, px q WHERE q.vec_id = p.vec_id AND q.r = least(greatest(p.r + dr, 0), 7) AND q.c = least(greatest(p.c + dc, 0), 7) GROUP BY 1, 2, 3
), m AS (SELECT *, abs(gx) + abs(gy) AS m FROM g),
n AS (
  SELECT p.vec_id, p.r, p.c, any_value(p.gx) AS gx, any_value(p.gy) AS gy, any_value(p.m) AS m, coalesce(max(CASE WHEN dr = 0 AND dc = -1 THEN q.m END), 0) AS l, coalesce(max(CASE WHEN dr = 0 AND dc = 1 THEN q.m END), 0) AS ri,
    coalesce(max(CASE WHEN dr = -1 AND dc = 0 THEN q.m END), 0) AS u, coalesce(max(CASE WHEN dr = 1 AND dc = 0 THEN q.m END), 0) AS d, coalesce(max(CASE WHEN dr = -1 AND dc = -1 THEN q.m END), 0) AS ul,
    coalesce(max(CASE WHEN dr = 1 AND dc = 1 THEN q.m END), 0) AS dr_, coalesce(max(CASE WHEN dr = -1 AND dc = 1 THEN q.m END), 0) AS ur, coalesce(max(CASE WHEN dr = 1 AND dc = -1 THEN q.m END), 0) AS dl
  FROM m p CROSS JOIN o LEFT JOIN m q ON q.vec_id = p.vec_id AND q.r = p.r + dr AND q.c = p.c + dc GROUP BY 1, 2, 3
), k AS (
  SELECT vec_id, r, c, m FROM n WHERE m > 50 AND CASE WHEN abs(gy) < tan(pi() / 8) * abs(gx) THEN m > l AND m >= ri WHEN abs(gy) > tan(3 * pi() / 8) * abs(gx) THEN m > u AND m >= d
    WHEN (gx < 0) <> (gy < 0) THEN m > ur AND m > dl ELSE m > ul AND m > dr_ END
), e(vec_id, r, c) AS (SELECT vec_id, r, c FROM k WHERE m > 150 UNION SELECT k.vec_id, k.r, k.c FROM e JOIN k ON k.vec_id = e.vec_id AND abs(k.r - e.r) <= 1 AND abs(k.c - e.c) <= 1)
SELECT i.vec_id, count(e.r) AS edge_pixels, count(e.r) / 64.0 AS edge_density FROM (SELECT DISTINCT vec_id FROM px) i LEFT JOIN e ON e.vec_id = i.vec_id GROUP BY 1
"""


@query(_CANNY)
def img_edge_density(t: Tables) -> DataFrame:
    """Share of edge pixels with thresholds 50 and 150."""
    counts = E.canny(_gray(t), "vec_id", 50.0, 150.0).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    joined = t.embeddings.select("vec_id").join(counts, "vec_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("vec_id", F.col("n").alias("edge_pixels"), (F.col("n") / 64.0).cast("double").alias("edge_density"))


def _gray(t: Tables) -> DataFrame:
    px = R.to_pixels(t.embeddings, "vec_id", "embedding", 8)
    return px.withColumn("value", F.least(F.greatest(F.floor((F.col("value") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("double"))


@query(
    f"WITH {_GRAY}, p AS (SELECT a.vec_id // 2 AS pair, a.r, a.c, a.v AS a, b.v AS b FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.r = a.r AND b.c = a.c WHERE a.vec_id % 2 = 0),"
    " w AS (SELECT pair, r0, c0, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM p, (SELECT unnest([3, 4]) AS r0) x, (SELECT unnest([3, 4]) AS c0) y WHERE abs(r - r0) <= 3 AND abs(c - c0) <= 3 GROUP BY 1, 2, 3)"
    " SELECT CAST(pair AS BIGINT) AS pair, round(avg((2 * ma * mb + 6.5025) * (2 * cab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM w GROUP BY 1"
)
def img_ssim(t: Tables) -> DataFrame:
    """Structural similarity of pairs of images over windows of 7 x 7."""
    side = lambda k, name: _gray(t).filter(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("pair"), "row", "col", F.col("value").alias(name))
    found = L.structural_similarity(side(0, "a").join(side(1, "b"), ["pair", "row", "col"]), "pair")
    return found.select("pair", F.round("ssim", 6).alias("ssim"))


@query(
    f"WITH {_GRAY}, i AS (SELECT vec_id // 3 AS image, r, c, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS v0, max(CASE WHEN vec_id % 3 = 1 THEN v END) AS v1, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS v2 FROM px GROUP BY 1, 2, 3 HAVING count(*) = 3),"
    " h AS (SELECT image // 2 AS pair, image % 2 AS side, floor(v0 / 16) * 256 + floor(v1 / 16) * 16 + floor(v2 / 16) AS bin, count(*) / 64.0 AS p FROM i GROUP BY 1, 2, 3), a AS (SELECT * FROM h WHERE side = 0), b AS (SELECT * FROM h WHERE side = 1)"
    " SELECT CAST(coalesce(a.pair, b.pair) AS BIGINT) AS pair, round(sqrt(greatest(1 - sum(sqrt(coalesce(CAST(a.p AS DOUBLE), 0) * coalesce(CAST(b.p AS DOUBLE), 0))), 0)), 6) AS distance FROM a FULL JOIN b ON a.pair = b.pair AND a.bin = b.bin GROUP BY 1"
)
def img_colour_distance(t: Tables) -> DataFrame:
    """Distance of pairs of images by their joint histograms of three channels, 16 steps each."""
    k = F.floor(F.col("vec_id") / 3)
    wide = _gray(t).groupBy(k.alias("image"), "row", "col").agg(*(F.max(F.when(F.col("vec_id") % 3 == c, F.col("value"))).alias(f"v{c}") for c in range(3))).dropna()
    side = lambda n: wide.filter(F.col("image") % 2 == n).select(F.floor(F.col("image") / 2).alias("pair"), "v0", "v1", "v2")
    return L.colour_distance(side(0), side(1), "pair", ["v0", "v1", "v2"]).select("pair", F.round("distance", 6).alias("distance"))


_STEPS = " OR ".join("(h.held = '%s' AND s.stage IN (%s))" % (a, ", ".join(f"'{x}'" for x in after)) for a, after in C.VALID_TRANSITIONS)


@query(
    "WITH RECURSIVE s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_linenumber, CASE WHEN d < -8 THEN 'cleared_lot' WHEN d < -6 THEN 'destroyed' WHEN d < -4 THEN 'foundation_framing' WHEN d <= -1.5 THEN 'structure_substantial' WHEN d > -1.5 THEN 'rebuild_complete' END AS stage"
    " FROM (SELECT *, CASE WHEN l_partkey % 10 <> 0 THEN l_quantity / 5 - 10 END AS d FROM lineitem)),"
    " h AS (SELECT k, n, l_linenumber, stage, stage AS held, false AS uncertain FROM s WHERE n = 1"
    f" UNION ALL SELECT s.k, s.n, s.l_linenumber, s.stage, CASE WHEN s.stage IS NULL THEN h.held WHEN h.held IS NULL OR {_STEPS} THEN s.stage ELSE h.held END, coalesce(NOT (h.held IS NULL OR s.stage = h.held OR {_STEPS}), false) FROM h JOIN s ON s.k = h.k AND s.n = h.n + 1)"
    " SELECT k AS l_orderkey, l_linenumber, stage, held, uncertain FROM h"
)
def cas08_held(t: Tables) -> DataFrame:
    """Stages that never go back: an impossible one is held at the stage before and flagged; a tenth have no reading."""
    delta = F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity") / 5 - 10)
    staged = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.rebuild_stage(delta).alias("stage"))
    return S.hold_monotone(staged, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "stage", C.VALID_TRANSITIONS).select("l_orderkey", "l_linenumber", "stage", "held", "uncertain")
