"""Curvature, gates and recovery detection over the daily series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fits
from ..operators import recovery as R
from ..staging import written
from .registry import Tables, query
from .series import EVENT_DAY, SERIES, SMOOTH, daily, smoothed

LEAST = 10
#: Quantiles of rounded inputs often end in a 5 just where they are rounded: both engines round this much further on.
OFF_EDGE = 1e-7


def _quadratic_sql(source: str, extra: str = "", name: str = "fit") -> str:
    """Common table expressions from ``source`` (user_id, t, y, w) to ``name`` (user_id, n, a, vertex)."""
    g, c = "user_id" + (f", {extra}" if extra else ""), f"{name}_c"
    return (
        f"{c}0 AS (SELECT *, sum(t * w) OVER (PARTITION BY {g}) / sum(w) OVER (PARTITION BY {g}) AS c FROM {source}), {c}1 AS (SELECT {g}, sum(w) AS n, min(c) AS c, sum(w * (t - c) ** 2) AS s2, sum(w * (t - c) ** 3) AS s3, sum(w * (t - c) ** 4) AS s4, sum(w * y) AS t0, sum(w * (t - c) * y) AS t1, sum(w * (t - c) ** 2 * y) AS t2 FROM {c}0 GROUP BY {g}),"
        f" {c}2 AS (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS a FROM {c}1), {name} AS (SELECT {g}, n, a, -((t1 - a * s3) / s2) / (2 * a) + c AS vertex FROM {c}2)"
    )


_POST = "p AS (SELECT user_id, CAST(d - 8 AS DOUBLE) AS t, x AS y, 1.0 AS w FROM s WHERE d >= 8 AND x IS NOT NULL)"


def _post(t: Tables) -> DataFrame:
    return daily(t).filter(F.col("d") >= EVENT_DAY).select("user_id", (F.col("d") - EVENT_DAY).cast("double").alias("t"), F.col("x").alias("y")).dropna()


@query(f"WITH {SERIES}, {_POST}, {_quadratic_sql('p')} SELECT user_id, CAST(n AS BIGINT) AS n, CASE WHEN n >= {LEAST} THEN round(a * 1e4, 2) END AS curvature, CASE WHEN n >= {LEAST} THEN round(vertex, 2) END AS vertex FROM fit")
def st03_quadratic(t: Tables) -> DataFrame:
    fit = R.fit_quadratic(_post(t), "user_id", "t", "y", least=LEAST)
    return fit.select("user_id", F.col("n").cast("long").alias("n"), F.round(F.col("a") * 1e4, 2).alias("curvature"), F.round("vertex", 2).alias("vertex"))


# Resampling by a hash instead of a generator, so that SQL can draw the same: point i counts md5-many times (0 to 2).
_TIMES = "CAST(('0x' || substr(md5(CAST(b AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 4)) AS INTEGER) % 3"
_CI = (
    f"r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM p), times AS (SELECT user_id, draw.b, t, y, CAST({_TIMES} AS DOUBLE) AS w FROM r, (SELECT unnest(range(0, {R.BOOTSTRAPS})) AS b) draw), v AS (SELECT * FROM times WHERE w > 0), {_quadratic_sql('v', 'b', 'resampled')},"
    " ci AS (SELECT user_id, quantile_cont(a * 1e4, 0.025) AS ci_lower, quantile_cont(a * 1e4, 0.975) AS ci_upper FROM resampled WHERE n >= 3 GROUP BY 1)"
)


@query(f"WITH {SERIES}, {_POST}, {_CI} SELECT user_id, round(ci_lower, 3) AS ci_lower, round(ci_upper, 3) AS ci_upper FROM ci")
def st04_bootstrap(t: Tables) -> DataFrame:
    """Confidence limits of the curvature of every user by resampling with hashed multiplicities."""
    return _hashed_ci(_post(t)).select("user_id", F.round("ci_lower", 3).alias("ci_lower"), F.round("ci_upper", 3).alias("ci_upper"))


@query()
def st04_bootstrap_whole(t: Tables) -> DataFrame:
    """The same, held against a plain loop."""
    return st04_bootstrap(t)


def _hashed_ci(rows: DataFrame) -> DataFrame:
    """By the multiplicities that the SQL draws."""
    return fits.bootstrap_limits(rows, "user_id", "t", "y", fits.hashed_times)


def _seeded_ci(rows: DataFrame) -> DataFrame:
    """By the seeded generator, for series with enough points."""
    limits = fits.bootstrap_limits(rows, "user_id", "t", "y")
    enough = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).select("user_id")
    return limits.join(enough, "user_id", "left_semi")


@query()
def st04_bootstrap_seeded(t: Tables) -> DataFrame:
    """The seeded generator's resamples: multiplicities depend on the length of a series alone."""
    return _seeded_ci(_post(t)).select("user_id", F.round("ci_lower", 2).alias("ci_lower"), F.round("ci_upper", 2).alias("ci_upper"))


def _gate(post: DataFrame, ci: DataFrame) -> DataFrame:
    """user_id, smile_valid: enough points, and the lower limit, unrounded, at the gate or above."""
    valid = F.coalesce(F.col("ci_lower") >= R.CI_LOWER_GATE, F.lit(False))
    return post.groupBy("user_id").agg(F.count("*").alias("n")).join(ci, "user_id", "left").select("user_id", ((F.col("n") >= LEAST) & valid).alias("smile_valid"))


@query(f"WITH {SERIES}, {_POST}, {_CI}, sizes AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1) SELECT user_id, n >= {LEAST} AND coalesce(ci_lower >= 2.0, false) AS smile_valid FROM sizes LEFT JOIN ci USING (user_id)")
def st05_gate(t: Tables) -> DataFrame:
    """Validity by the unrounded lower limit of the hashed bootstrap."""
    post = _post(t)
    return _gate(post, _hashed_ci(post))


@query()
def st05_gate_bootstrap(t: Tables) -> DataFrame:
    """The same gate by the seeded generator, which SQL can't draw."""
    post = _post(t)
    return _gate(post, _seeded_ci(post))


_BASE = "b AS (SELECT user_id, quantile_cont(x, 0.75) AS pre_baseline, count(x) AS nb FROM s WHERE d < 8 AND x IS NOT NULL GROUP BY 1 HAVING count(x) >= 3)"


@query(f"WITH {SERIES}, {_BASE} SELECT user_id, round(pre_baseline + 1e-7, 4) AS pre_baseline, round(least(pre_baseline * 0.90, 60) + 1e-7, 4) AS threshold FROM b")
def st07_baseline(t: Tables) -> DataFrame:
    """Baseline of the days before the event, and the threshold: a share of it under a cap (60 suits these values)."""
    base = R.baseline(daily(t), "user_id", "x", F.col("d") < EVENT_DAY)
    return base.select("user_id", F.round(F.col("pre_baseline") + OFF_EDGE, 4).alias("pre_baseline"), F.round(F.least(F.col("pre_baseline") * R.THRESHOLD_SHARE, F.lit(60.0)) + OFF_EDGE, 4).alias("threshold"))


_TAUS = int((R.TAU_HIGH - R.TAU_LOW) / R.TAU_STEP) + 1
_EXP = (
    f"q AS (SELECT p.user_id, p.t, p.y, b.pre_baseline AS base FROM p JOIN b USING (user_id)), k AS (SELECT user_id, count(*) AS n, min(t) AS t0, min(y) AS ymin, avg(y) AS ymean, min(base) AS base FROM q GROUP BY 1), g AS (SELECT q.user_id, tau, sum(exp(-(t - t0) / tau) * (y - q.base * (1 - exp(-(t - t0) / tau)))) AS er, sum(exp(-(t - t0) / tau) ** 2) AS ee, sum((y - q.base * (1 - exp(-(t - t0) / tau))) ** 2) AS rr, sum((y - ymean) ** 2) AS tot FROM q JOIN k ON k.user_id = q.user_id, (SELECT 1 + 0.5 * i AS tau FROM (SELECT unnest(range(0, {_TAUS})) AS i)) GROUP BY 1, 2),"
    " h AS (SELECT g.*, n, ymin, base, least(greatest(er / ee, 0), base) AS c FROM g JOIN k USING (user_id)), j AS (SELECT *, rr - 2 * c * er + c * c * ee AS sse, row_number() OVER (PARTITION BY user_id ORDER BY rr - 2 * c * er + c * c * ee, tau) AS rn FROM h),"
    f" ex AS (SELECT user_id, CASE WHEN n >= {LEAST} AND base > 0 AND ymin BETWEEN 0 AND base AND 1 - sse / tot >= 0.3 THEN round(CAST(tau AS DOUBLE), 2) END AS recovery_tau, CASE WHEN n >= {LEAST} AND base > 0 AND ymin BETWEEN 0 AND base THEN round(c, 4) END AS recovery_cmin, CASE WHEN n >= {LEAST} AND base > 0 AND ymin BETWEEN 0 AND base THEN round(CASE WHEN tot > 0 THEN 1 - sse / tot ELSE 0 END, 3) END AS recovery_r2 FROM j WHERE rn = 1)"
)


@query(f"WITH {SERIES}, {_POST}, {_BASE}, {_EXP} SELECT * FROM ex")
def st06_expfit(t: Tables) -> DataFrame:
    base = R.baseline(daily(t), "user_id", "x", F.col("d") < EVENT_DAY).select("user_id", "pre_baseline")
    return fits.fit_grid(_post(t).join(base, "user_id"), "user_id", "t", "y", "pre_baseline")


# A scan in steps of a half, then one in steps of a thousandth about its best.
_SCAN = (
    f"q AS (SELECT p.user_id, p.t - min(p.t) OVER (PARTITION BY p.user_id) AS t, p.y, b.pre_baseline AS base FROM p JOIN b USING (user_id)), k AS (SELECT user_id, count(*) AS n, min(y) AS ymin, avg(y) AS ymean, min(base) AS base FROM q GROUP BY 1),"
    f" g AS (SELECT user_id, tau, sum(exp(-t / tau) * (y - base * (1 - exp(-t / tau)))) AS er, sum(exp(-t / tau) ** 2) AS ee, sum((y - base * (1 - exp(-t / tau))) ** 2) AS rr, min(base) AS base FROM q, (SELECT 1 + 0.5 * i AS tau FROM (SELECT unnest(range(0, {_TAUS})) AS i)) GROUP BY 1, 2), h AS (SELECT *, least(greatest(er / ee, 0), base) AS c FROM g),"
    " w AS (SELECT user_id, CAST(arg_min(tau, rr - 2 * c * er + c * c * ee) AS DOUBLE) AS near FROM h GROUP BY 1), f AS (SELECT q.*, least(greatest(near + i / 1000.0, 1), 60) AS tau FROM q JOIN w USING (user_id), (SELECT unnest(range(-500, 501)) AS i)),"
    " g2 AS (SELECT user_id, tau, sum(exp(-t / tau) * (y - base * (1 - exp(-t / tau)))) AS er, sum(exp(-t / tau) ** 2) AS ee, sum((y - base * (1 - exp(-t / tau))) ** 2) AS rr, min(base) AS base FROM (SELECT DISTINCT * FROM f) GROUP BY 1, 2), h2 AS (SELECT *, least(greatest(er / ee, 0), base) AS c FROM g2),"
    " m AS (SELECT user_id, min(rr - 2 * c * er + c * c * ee) AS sse FROM h2 GROUP BY 1), tot AS (SELECT q.user_id, sum((y - ymean) ** 2) AS tot FROM q JOIN k USING (user_id) GROUP BY 1)"
)


@query(
    f"WITH {SERIES}, {_POST}, {_BASE}, {_SCAN}, z AS (SELECT user_id, n >= {LEAST} AND base > 0 AND ymin BETWEEN 0 AND base AS ok, CASE WHEN tot > 0 THEN 1 - sse / tot ELSE 0 END AS r2 FROM k JOIN m USING (user_id) JOIN tot USING (user_id))"
    " SELECT user_id, ok AS fitted, CASE WHEN ok THEN r2 >= 0.3 END AS has_tau, CASE WHEN ok THEN round(r2 + 1e-7, 2) + 0.0 END AS r2 FROM z"
)
def st06_relaxation(t: Tables) -> DataFrame:
    """The exponential fit with a continuous tau: what its best value explains, as a dense scan finds it."""
    base = R.baseline(daily(t), "user_id", "x", F.col("d") < EVENT_DAY).select("user_id", "pre_baseline")
    found = fits.fit_relaxation(_post(t).join(base, "user_id"), "user_id", "t", "y", "pre_baseline")
    return found.select("user_id", F.col("r2").isNotNull().alias("fitted"), F.when(F.col("r2").isNotNull(), F.col("tau").isNotNull()).alias("has_tau"), (F.round(F.col("r2") + OFF_EDGE, 2) + 0.0).alias("r2"))


@query(
    f"WITH {SMOOTH}, {_POST}, {_BASE}, {_quadratic_sql('p')}, {_CI}, {_EXP}, gate AS (SELECT b.user_id, pre_baseline, least(pre_baseline * 0.90, 60) AS threshold, CASE WHEN n >= {LEAST} THEN vertex END AS vertex, CASE WHEN n >= {LEAST} THEN a END AS a, coalesce(n >= {LEAST} AND ci_lower >= 2.0, false) AS valid FROM b LEFT JOIN fit USING (user_id) LEFT JOIN ci USING (user_id)),"
    " run AS (SELECT sm.user_id, d, (d - 8) / 4.0 AS month, sum(CASE WHEN smoothed >= threshold AND valid AND (d - 8) / 4.0 >= greatest(coalesce(vertex / 4.0, 2), 2) THEN 1 ELSE 0 END) OVER (PARTITION BY sm.user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM sm JOIN gate USING (user_id) WHERE d >= 8), hit AS (SELECT user_id, min(CASE WHEN run = 5 THEN month END) AS m FROM run GROUP BY 1)"
    " SELECT gate.user_id, 'Destroyed' AS damage_class, round(pre_baseline + 1e-7, 4) AS pre_baseline, nullif(round(CAST(m AS DOUBLE), 2), 0) AS recovery_months_post_fire, round(a * 1e4, 2) AS smile_curvature, round(vertex, 2) AS vertex_months, valid AS smile_valid, recovery_tau, recovery_cmin, recovery_r2 FROM gate LEFT JOIN hit USING (user_id) LEFT JOIN ex USING (user_id)"
)
def st08_recovery(t: Tables) -> DataFrame:
    """The whole detection, of every user: baseline, threshold, curvature valid by the bootstrap's lower limit, smoothed
    sustained crossing after the vertex, exponential fit. Four days stand for a month, and two months for the least
    delay."""
    return _recovery(t, _hashed_ci)


@query()
def st08_recovery_bootstrap(t: Tables) -> DataFrame:
    """``st08_recovery`` with the seeded generator's gate."""
    return _recovery(t, _seeded_ci)


def _recovery(t: Tables, limits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``limits`` gives the bootstrap's limits of a series. The series is made once and written; all else reads it."""
    rows = written(smoothed(t).select("user_id", "d", "x", "smoothed"), "series")
    post = rows.filter(F.col("d") >= EVENT_DAY).select("user_id", (F.col("d") - EVENT_DAY).cast("double").alias("t"), F.col("x").alias("y")).dropna()
    fit = R.fit_quadratic(post, "user_id", "t", "y", least=LEAST).join(_gate(post, limits(post)), "user_id", "left")
    base = R.baseline(rows, "user_id", "x", F.col("d") < EVENT_DAY)
    valid = F.coalesce("smile_valid", F.lit(False))
    gates = base.join(fit, "user_id", "left").select("user_id", "pre_baseline", F.least(F.col("pre_baseline") * R.THRESHOLD_SHARE, F.lit(60.0)).alias("threshold"), "a", "vertex", valid.alias("valid"))
    from ..operators.series import sustained_crossing

    after = rows.filter(F.col("d") >= EVENT_DAY).join(gates.select("user_id", "threshold", "vertex", "valid"), "user_id").withColumn("month", (F.col("d") - EVENT_DAY) / 4.0)
    late = F.when(F.col("valid") & (F.col("month") >= F.greatest(F.coalesce(F.col("vertex") / 4.0, F.lit(2.0)), F.lit(2.0))), F.col("smoothed"))
    found = sustained_crossing(after.withColumn("late", late), "late", F.col("threshold"), "user_id", "d", F.lit(EVENT_DAY))
    shape = fits.fit_grid(post.join(base.select("user_id", "pre_baseline"), "user_id"), "user_id", "t", "y", "pre_baseline")
    joined = gates.join(found, "user_id", "left").join(shape, "user_id", "left")
    return joined.select(
        "user_id", F.lit("Destroyed").alias("damage_class"), F.round(F.col("pre_baseline") + OFF_EDGE, 4).alias("pre_baseline"), F.nullif(F.round((F.col("crossing") - EVENT_DAY) / 4.0, 2), F.lit(0.0)).alias("recovery_months_post_fire"), F.round(F.col("a") * 1e4, 2).alias("smile_curvature"),
        F.round("vertex", 2).alias("vertex_months"), F.col("valid").alias("smile_valid"), "recovery_tau", "recovery_cmin", "recovery_r2",
    )
