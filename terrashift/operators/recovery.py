"""Curvature validation and recovery detection over dense series (key, idx, month, value).

Everything is window and aggregate expressions: quadratic fits from centred power sums, bootstrap by multiplicities,
the exponential fit by scanning its one non-linear parameter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .series import sustained_crossing

MIN_POINTS = 10
BOOTSTRAPS, SEED = 200, 42
CI_LOWER_GATE = 2.0
BASELINE_QUANTILE, BASELINE_MIN = 0.75, 3
THRESHOLD_SHARE, THRESHOLD_CAP = 0.90, 1.05
MIN_DELAY_MONTHS = 6.0
R2_GATE = 0.3
TAU_LOW, TAU_HIGH, TAU_STEP = 1.0, 60.0, 0.5


def quadratic(n: Column, s: dict[int, Column], t: dict[int, Column], center: Column) -> tuple[Column, Column]:
    """Leading coefficient and vertex of the least-squares parabola, from sums over u = x - center with sum(u) = 0:
    s[p] = sum u^p, t[p] = sum u^p y. Null for a degenerate design."""
    over = lambda a, b: F.try_divide(a, b)
    a = over(t[2] - over(s[2] * t[0], n) - over(s[3] * t[1], s[2]), s[4] - over(s[2] * s[2], n) - over(s[3] * s[3], s[2]))
    b = over(t[1] - a * s[3], s[2])
    return a, over(-b, 2 * a) + center


def fit_quadratic(rows: DataFrame, key: str, x: str, y: str, weight: Column | None = None, least: int = MIN_POINTS) -> DataFrame:
    """key, n, a, vertex of y over x by key; null under ``least`` points. ``weight`` counts repeats of a point."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    valid = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__w", w)
    mean = valid.groupBy(key).agg((F.sum(F.col(x) * F.col("__w")) / F.sum("__w")).alias("__c"))
    u = valid.join(mean, key).withColumn("__u", F.col(x) - F.col("__c"))
    power = lambda p: F.pow("__u", F.lit(float(p)))
    sums = [F.sum(F.col("__w") * power(p)).alias(f"s{p}") for p in (2, 3, 4)] + [F.sum(F.col("__w") * power(p) * F.col(y)).alias(f"t{p}") for p in (0, 1, 2)]
    got = u.groupBy(key).agg(F.sum("__w").alias("n"), F.first("__c").alias("c"), *sums)
    a, vertex = quadratic(F.col("n"), {p: F.col(f"s{p}") for p in (2, 3, 4)}, {p: F.col(f"t{p}") for p in (0, 1, 2)}, F.col("c"))
    enough = F.col("n") >= least
    return got.select(key, F.col("n"), F.when(enough, a).alias("a"), F.when(enough, vertex).alias("vertex"))


def multiplicities(spark: SparkSession, sizes: list[int], draws: int = BOOTSTRAPS, seed: int = SEED) -> DataFrame:
    """n, draw, i, times: how often resample ``draw`` of n points takes point i. The generator starts anew for each n,
    so the table depends on nothing but n; n is the length of a series, which bounds it."""
    rows = []
    for n in sizes:
        rng = np.random.default_rng(seed)
        for b in range(draws):
            rows += [(n, b, i, int(c)) for i, c in enumerate(np.bincount(rng.choice(n, n, replace=True), minlength=n)) if c]
    return spark.createDataFrame(rows, "n int, draw int, i int, times int")


def bootstrap_ci(rows: DataFrame, key: str, x: str, y: str, table: DataFrame) -> DataFrame:
    """key, ci_lower, ci_upper: 2.5 and 97.5 percentiles of 1e4 times the leading coefficient over the resamples."""
    valid = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = valid.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(x)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int"))
    drawn = placed.join(table, ["n", "i"]).withColumn("__g", F.struct(key, "draw"))
    fits = fit_quadratic(drawn, "__g", x, y, F.col("times"), least=3)
    values = fits.select(F.col(f"__g.{key}").alias(key), (F.col("a") * 1e4).alias("a"))
    return values.groupBy(key).agg(F.percentile("a", F.lit(0.025)).alias("ci_lower"), F.percentile("a", F.lit(0.975)).alias("ci_upper"))


def baseline(rows: DataFrame, key: str, y: str, before: Column, quantile: float = BASELINE_QUANTILE) -> DataFrame:
    """key, pre_baseline, threshold from the rows before the event; keys with under three values have no row."""
    pre = rows.filter(before & F.col(y).isNotNull()).groupBy(key).agg(F.percentile(y, F.lit(quantile)).alias("pre_baseline"), F.count(y).alias("__n"))
    return pre.filter(F.col("__n") >= BASELINE_MIN).select(key, "pre_baseline", F.least(F.col("pre_baseline") * THRESHOLD_SHARE, F.lit(THRESHOLD_CAP)).alias("threshold"))


def fit_exponential(rows: DataFrame, key: str, t: str, y: str, base: str, least: int = MIN_POINTS) -> DataFrame:
    """key, tau, cmin, r2 of y = base - (base - cmin) e^-(t - t0)/tau, with cmin in [0, base] and tau in [1, 60].

    For a fixed tau the best cmin is closed form, so tau is scanned: sums for each (key, tau), then the least squares
    one. Nulls where there are too few points, no positive base, or a start value outside the bounds; tau is null where
    r2 is under 0.3; r2 is 0 for a constant series."""
    valid = rows.filter(F.col(t).isNotNull() & F.col(y).isNotNull())
    stats = valid.groupBy(key).agg(F.count(y).alias("__n"), F.min(t).alias("__t0"), F.min(y).alias("__ymin"), F.avg(y).alias("__ymean"))
    taus = F.transform(F.sequence(F.lit(0), F.lit(int((TAU_HIGH - TAU_LOW) / TAU_STEP))), lambda i: i * TAU_STEP + TAU_LOW)
    scan = valid.join(stats, key).withColumn("__tau", F.explode(taus))
    e = F.exp(-(F.col(t) - F.col("__t0")) / F.col("__tau"))
    b = F.col(base)
    r = F.col(y) - b * (1 - F.col("__e"))
    sums = scan.withColumn("__e", e).groupBy(key, "__tau", "__n", "__ymin", base).agg(F.sum(F.col("__e") * r).alias("er"), F.sum(F.col("__e") * F.col("__e")).alias("ee"), F.sum(r * r).alias("rr"), F.sum((F.col(y) - F.col("__ymean")) * (F.col(y) - F.col("__ymean"))).alias("tot"))
    c = F.least(F.greatest(F.col("er") / F.col("ee"), F.lit(0.0)), b)
    fits = sums.withColumn("__cmin", c).withColumn("__sse", F.col("rr") - 2 * F.col("__cmin") * F.col("er") + F.col("__cmin") * F.col("__cmin") * F.col("ee"))
    best = fits.groupBy(key).agg(F.min(F.struct("__sse", "__tau", "__cmin", "tot", "__n", "__ymin", base)).alias("f"))
    ok = (F.col("f.__n") >= least) & (F.col(f"f.{base}") > 0) & F.col("f.__ymin").between(F.lit(0.0), F.col(f"f.{base}"))
    r2 = F.when(F.col("f.tot") > 0, 1 - F.col("f.__sse") / F.col("f.tot")).otherwise(0.0)
    return best.select(key, F.when(ok & (r2 >= R2_GATE), F.round("f.__tau", 2)).alias("recovery_tau"), F.when(ok, F.round("f.__cmin", 4)).alias("recovery_cmin"), F.when(ok, F.round(r2, 3)).alias("recovery_r2"))


def inflection(rows: DataFrame, permits: DataFrame, key: str, idx: str, y: str, permit: str) -> DataFrame:
    """key, inflection: the first index of three rises in a row, no sooner than the series' trough (its first least value)
    and the key's permit; null where there is none, or no permit."""
    w = Window.partitionBy(key).orderBy(idx)
    ahead = rows.select(key, idx, y, *(F.lead(y, k).over(w).alias(f"__y{k}") for k in (1, 2, 3)))
    trough = rows.groupBy(key).agg(F.min_by(idx, F.struct(y, idx)).alias("__trough"))
    joined = ahead.join(trough, key).join(permits.select(key, F.col(permit).alias("__permit")), key, "left")
    rise = (F.col("__y1") > F.col(y)) & (F.col("__y2") > F.col("__y1")) & (F.col("__y3") > F.col("__y2")) & (F.col(idx) >= F.col("__trough")) & (F.col(idx) >= F.col("__permit"))
    return joined.groupBy(key).agg(F.min(F.when(rise, F.col(idx))).alias("inflection"))


def detect(rows: DataFrame, key: str, idx: str, month: str, smoothed: str, gates: DataFrame) -> DataFrame:
    """key, recovery_months: month of the first sustained crossing of the threshold, no sooner than the later of the
    curve's vertex and six months. ``gates``: key, threshold, vertex, valid; only valid keys can recover."""
    joined = rows.join(gates, key)
    delay = F.greatest(F.coalesce("vertex", F.lit(MIN_DELAY_MONTHS)), F.lit(MIN_DELAY_MONTHS))
    late = F.when(F.col("valid") & (F.col(month) >= delay), F.col(smoothed))
    found = sustained_crossing(joined.withColumn("__late", late), "__late", F.col("threshold"), key, idx, F.lit(0))
    at = joined.select(key, F.col(idx).alias("crossing"), F.col(month).alias("recovery_months"))
    return found.join(at, [key, "crossing"], "left").select(key, "recovery_months")
