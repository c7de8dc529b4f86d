"""Raster queries: an embedding of 64 floats is a scene of 8 x 8 pixels, two of them a complex one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import raster as R
from .registry import Tables, query

_PIXELS = "px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"
# A source pixel for each of the 25 offsets, reflected at the border.
_OFF = "o AS (SELECT a.x AS dr, b.x AS dc FROM (SELECT unnest(range(-2, 3)) AS x) a, (SELECT unnest(range(-2, 3)) AS x) b), n AS (SELECT p.r, p.c, CASE WHEN p.r + dr < 0 THEN -(p.r + dr) - 1 WHEN p.r + dr > 7 THEN 15 - (p.r + dr) ELSE p.r + dr END AS sr, CASE WHEN p.c + dc < 0 THEN -(p.c + dc) - 1 WHEN p.c + dc > 7 THEN 15 - (p.c + dc) ELSE p.c + dc END AS sc FROM (SELECT a.x AS r, b.x AS c FROM (SELECT unnest(range(0, 8)) AS x) a, (SELECT unnest(range(0, 8)) AS x) b) p, o)"


def _pixels(t: Tables) -> DataFrame:
    return R.to_pixels(t.embeddings, "vec_id", "embedding", 8)


@query(f"WITH {_PIXELS} SELECT vec_id, r // 4 * 2 + c // 4 AS zone, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(max(v) - min(v), 6) AS spread, round(median(v), 6) AS med, count(*) AS n FROM px GROUP BY 1, 2")
def agg29_zonal_stats(t: Tables) -> DataFrame:
    zoned = _pixels(t).withColumn("zone", F.floor(F.col("row") / 4) * 2 + F.floor(F.col("col") / 4))
    stats = R.zonal(zoned, ["vec_id", "zone"], least=3)
    return stats.select("vec_id", "zone", *(F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi", "spread", "med")), "n")


@query("WITH m AS (SELECT d, avg(CASE WHEN cls = 0 THEN value END) AS a, avg(CASE WHEN cls = 2 THEN value END) AS b, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS d, user_id % 3 AS cls, value FROM events) GROUP BY 1) SELECT d, CASE WHEN n >= 20 THEN round(abs(a - b), 6) END AS separation FROM m")
def agg31_separation(t: Tables) -> DataFrame:
    """Distance of two class means by day, where there are values enough."""
    cls = F.col("user_id") % 3
    mean = lambda k: F.avg(F.when(cls == k, F.col("value")))
    return t.events.groupBy(F.to_date("ts").alias("d")).agg(F.when(F.count("*") >= 20, F.round(F.abs(mean(0) - mean(2)), 6)).alias("separation"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0.02 AND l_tax > 0.02 THEN (l_discount + l_tax) / 2 WHEN l_discount > 0.02 THEN l_discount WHEN l_tax > 0.02 THEN l_tax END, 6) AS mean FROM lineitem")
def agg32_nanmean(t: Tables) -> DataFrame:
    present = lambda c: F.when(F.col(c) > 0.02, F.col(c))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(N.mean_of_present(present("l_discount"), present("l_tax")), 6).alias("mean"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM px WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 6 GROUP BY 1")
def agg37_roi(t: Tables) -> DataFrame:
    roi = _pixels(t).filter(F.col("row").between(2, 5) & F.col("col").between(1, 6))
    return roi.groupBy("vec_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"))


@query(f"WITH {_PIXELS} SELECT label, round(median(v), 6) AS med, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM px JOIN embeddings USING (vec_id) GROUP BY 1 HAVING count(*) >= 3")
def agg39_zonal_median(t: Tables) -> DataFrame:
    rows = _pixels(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    stats = rows.groupBy("label").agg(F.round(F.median("value"), 6).alias("med"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
    return stats.filter("n >= 3")


@query(f"WITH {_PIXELS}, {_OFF} SELECT s.vec_id, CAST(n.r AS INTEGER) AS \"row\", CAST(n.c AS INTEGER) AS col, round(avg(s.v), 6) + 0.0 AS mean FROM n JOIN px s ON s.r = n.sr AND s.c = n.sc GROUP BY 1, 2, 3")
def win08_boxfilter(t: Tables) -> DataFrame:
    """Means of 5 x 5 pixels; a zero has no sign."""
    return R.box_mean(_pixels(t), "vec_id", ["value"], 8, 8).select("vec_id", "row", "col", (F.round("value", 6) + 0.0).alias("mean"))


@query(
    f"WITH {_PIXELS}, {_OFF}, z AS (SELECT a.vec_id // 4 AS pair, a.r, a.c, a.v AS re1, b.v AS im1, c.v AS re2, d.v AS im2 FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.r = a.r AND b.c = a.c JOIN px c ON c.vec_id = a.vec_id + 2 AND c.r = a.r AND c.c = a.c JOIN px d ON d.vec_id = a.vec_id + 3 AND d.r = a.r AND d.c = a.c WHERE a.vec_id % 4 = 0),"
    " k AS (SELECT z.pair, n.r, n.c, avg(re1 * re2 + im1 * im2) AS cr, avg(im1 * re2 - re1 * im2) AS ci, avg(re1 * re1 + im1 * im1) AS p1, avg(re2 * re2 + im2 * im2) AS p2 FROM n JOIN z ON z.r = n.sr AND z.c = n.sc GROUP BY 1, 2, 3)"
    " SELECT CAST(pair AS BIGINT) AS pair, CAST(r AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col, round(CASE WHEN p1 * p2 > 0 THEN sqrt(cr * cr + ci * ci) / sqrt(p1 * p2) ELSE 0 END, 6) AS coherence FROM k"
)
def st01_coherence(t: Tables) -> DataFrame:
    """Four embeddings in a row are the parts of a pair of complex scenes."""
    names = {0: "re1", 1: "im1", 2: "re2", 3: "im2"}
    px = _pixels(t).withColumn("pair", F.floor(F.col("vec_id") / 4)).withColumn("part", F.col("vec_id") % 4)
    wide = px.groupBy("pair", "row", "col").agg(*(F.max(F.when(F.col("part") == k, F.col("value"))).alias(n) for k, n in names.items())).filter("im2 is not null")
    return R.coherence(wide, "pair", 8, 8).select("pair", "row", "col", F.round("coherence", 6).alias("coherence"))


@query(f"WITH {_PIXELS}, h AS (SELECT vec_id, least(floor((v + 4) / 8 * 8), 7) AS bin, count(*) AS n FROM px WHERE v BETWEEN -4 AND 4 GROUP BY 1, 2) SELECT vec_id, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n), 6) AS entropy FROM h GROUP BY 1")
def img_entropy(t: Tables) -> DataFrame:
    return R.entropy(_pixels(t), "vec_id", -4.0, 4.0, 8).select("vec_id", F.round("entropy", 6).alias("entropy"))


@query(
    f"WITH {_PIXELS}, s AS (SELECT a.vec_id, a.r, a.c, (SELECT v FROM px b WHERE b.vec_id = a.vec_id AND b.r = CASE WHEN a.r = 0 THEN 1 ELSE a.r - 1 END AND b.c = a.c) + (SELECT v FROM px b WHERE b.vec_id = a.vec_id AND b.r = CASE WHEN a.r = 7 THEN 6 ELSE a.r + 1 END AND b.c = a.c) + (SELECT v FROM px b WHERE b.vec_id = a.vec_id AND b.r = a.r AND b.c = CASE WHEN a.c = 0 THEN 1 ELSE a.c - 1 END) + (SELECT v FROM px b WHERE b.vec_id = a.vec_id AND b.r = a.r AND b.c = CASE WHEN a.c = 7 THEN 6 ELSE a.c + 1 END) - 4 * a.v AS l FROM px a)"
    " SELECT vec_id, round(coalesce(var_pop(l), 0), 6) AS sharpness FROM s WHERE (r + c) % 2 = 0 GROUP BY 1"
)
def img_laplacian_var(t: Tables) -> DataFrame:
    """Population variance of the Laplacian under a mask."""
    masked = R.laplacian(_pixels(t), "vec_id", 8, 8).filter((F.col("row") + F.col("col")) % 2 == 0)
    return masked.groupBy("vec_id").agg(F.round(F.coalesce(F.var_pop("laplacian"), F.lit(0.0)), 6).alias("sharpness"))


@query(
    f"WITH {_PIXELS}, h AS (SELECT vec_id, least(floor((v + 4) / 8 * 8), 7) AS bin, count(*) / 64.0 AS p FROM px WHERE v BETWEEN -4 AND 4 GROUP BY 1, 2), a AS (SELECT vec_id // 2 AS pair, bin, CAST(p AS DOUBLE) AS p FROM h WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 2 AS pair, bin, CAST(p AS DOUBLE) AS q FROM h WHERE vec_id % 2 = 1)"
    " SELECT CAST(pair AS BIGINT) AS pair, round(sqrt(greatest(1 - sum(sqrt(coalesce(p, 0) * coalesce(q, 0))), 0)), 6) AS distance FROM a FULL JOIN b USING (pair, bin) GROUP BY 1"
)
def img_histogram_distance(t: Tables) -> DataFrame:
    at = F.least(F.floor((F.col("value") + 4) / 8 * 8), F.lit(7))
    hist = _pixels(t).filter(F.col("value").between(-4, 4)).groupBy("vec_id", at.alias("bin")).agg((F.count("*") / 64.0).cast("double").alias("p"))
    side = lambda k: hist.filter(F.col("vec_id") % 2 == k).select(F.floor(F.col("vec_id") / 2).alias("pair"), "bin", "p")
    return R.bhattacharyya(side(0), side(1), "pair").select("pair", F.round("distance", 6).alias("distance"))
