"""Fits over whole series, a row a key: resampled parabolas and bounded relaxation curves.

A key's points are gathered once, which their number bounds (a series has a point a date), and all resamples or all steps
of a search run over that one row; nothing is copied or shuffled for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import BOOTSTRAPS, MIN_POINTS, R2_GATE, SEED, TAU_HIGH, TAU_LOW, TAU_STEP

GOLDEN = (5**0.5 - 1) / 2


@lru_cache(64)
def seeded_times(n: int, draws: int = BOOTSTRAPS, seed: int = SEED) -> np.ndarray:
    """How often resample b of n points takes point i, by the seeded generator; it starts anew for each n."""
    rng = np.random.default_rng(seed)
    return np.stack([np.bincount(rng.choice(n, n, replace=True), minlength=n) for _ in range(draws)]).astype(float)


@lru_cache(64)
def hashed_times(n: int, draws: int = BOOTSTRAPS) -> np.ndarray:
    """The same by a hash of draw and point, 0 to 2 times, so that SQL can draw it too."""
    return np.array([[int(hashlib.md5(f"{b}-{i}".encode()).hexdigest()[:4], 16) % 3 for i in range(n)] for b in range(draws)], float).reshape(draws, n)


def leading_coefficients(x: np.ndarray, y: np.ndarray, times: np.ndarray, least: int = 3) -> np.ndarray:
    """Of the least-squares parabola of each row of ``times``; NaN under ``least`` points or for a degenerate design."""
    with np.errstate(all="ignore"):
        n = times.sum(axis=1)
        u = x - (times @ x / n)[:, None]
        s2, s3, s4 = ((times * u**p).sum(axis=1) for p in (2, 3, 4))
        t0, t1, t2 = times @ y, (times * u) @ y, (times * u * u) @ y
        over = s4 - s2 * s2 / n - s3 * s3 / s2
        a = (t2 - s2 * t0 / n - s3 * t1 / s2) / over
        # Two places at most leave no parabola; what is left of the divisor is then rounding.
        return np.where((n >= least) & (over > 1e-9 * s4), a, np.nan)


def series_rows(rows: DataFrame, key: str, x: str, y: str, *more: str) -> DataFrame:
    """k, points (struct x, y, in order of x) and ``more``, the same for all rows of a key; points lacking a value are left out."""
    valid = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return valid.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("points"), *(F.first(m).cast("double").alias(m) for m in more))


def _points(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for p in b.column("points"):
        yield p.values.field("x").to_numpy(), p.values.field("y").to_numpy()


def bootstrap_limits(rows: DataFrame, key: str, x: str, y: str, times: Callable[[int], np.ndarray] = seeded_times) -> DataFrame:
    """key, ci_lower, ci_upper: 2.5 and 97.5 percentiles of 1e4 times the leading coefficient over the resamples that
    ``times(n)`` gives for a series of n points; nulls where no resample has a parabola."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits = np.full((b.num_rows, 2), np.nan)
            for i, (px, py) in enumerate(_points(b)):
                a = leading_coefficients(px, py, times(len(px)))
                a = a[~np.isnan(a)] * 1e4
                if len(a):
                    limits[i] = np.percentile(a, (2.5, 97.5))
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, mask=np.isnan(c)) for c in limits.T)], ["k", "ci_lower", "ci_upper"])

    made = series_rows(rows, key, x, y).mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, ci_lower double, ci_upper double")
    return made.withColumnRenamed("k", key)


def relaxation(t: np.ndarray, y: np.ndarray, base: float, steps: int = 60) -> tuple[float, float, float]:
    """tau, cmin and sum of squares of y = base - (base - cmin) e^-(t - t0)/tau, cmin in [0, base], tau in [1, 60].

    For a fixed tau the best cmin is closed form. The sum of squares may have several dips in tau, so a grid of ``steps``,
    even in log tau, finds the brackets of its lowest three dips, and golden sections narrow each to 1e-7."""
    t = t - t[0]

    def at(tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(-t / tau[:, None])
        r = y - base * (1 - e)
        c = np.clip((e * r).sum(axis=1) / (e * e).sum(axis=1), 0.0, base)
        return ((r - c[:, None] * e) ** 2).sum(axis=1), c

    grid = np.exp(np.linspace(np.log(TAU_LOW), np.log(TAU_HIGH), steps))
    sse = at(grid)[0]
    padded = np.concatenate([[np.inf], sse, [np.inf]])
    dips = np.flatnonzero((sse <= padded[:-2]) & (sse <= padded[2:]))
    dips = dips[np.argsort(sse[dips], kind="stable")][:3]
    low, high = grid[np.maximum(dips - 1, 0)], grid[np.minimum(dips + 1, steps - 1)]
    while (high - low).max() > 1e-7:
        span = GOLDEN * (high - low)
        left = at(high - span)[0] <= at(low + span)[0]
        low, high = np.where(left, low, high - span), np.where(left, low + span, high)
    ends = np.concatenate([low, high, grid[dips]])
    sse, c = at(ends)
    best = min(range(len(ends)), key=lambda i: (sse[i], ends[i]))
    return float(ends[best]), float(c[best]), float(sse[best])


def fit_relaxation(rows: DataFrame, key: str, t: str, y: str, base: str, least: int = MIN_POINTS) -> DataFrame:
    """key, tau, cmin, r2, unrounded, of keys with a point. Nulls under ``least`` points, without a positive base, or where
    the least value is outside [0, base]; tau is null where r2 is under 0.3; r2 is 0 for a constant series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((b.num_rows, 3), np.nan)
            for i, ((px, py), level) in enumerate(zip(_points(b), b.column(base).to_numpy(zero_copy_only=False), strict=True)):
                if len(px) >= least and level > 0 and 0 <= py.min() <= level:
                    tau, cmin, sse = relaxation(px, py, level)
                    total = ((py - py.mean()) ** 2).sum()
                    r2 = 1 - sse / total if total > 0 else 0.0
                    out[i] = (tau if r2 >= R2_GATE else np.nan, cmin, r2)
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, mask=np.isnan(c)) for c in out.T)], ["k", "tau", "cmin", "r2"])

    made = series_rows(rows, key, t, y, base).mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, tau double, cmin double, r2 double")
    return made.withColumnRenamed("k", key)


def fit_grid(rows: DataFrame, key: str, t: str, y: str, base: str, least: int = MIN_POINTS) -> DataFrame:
    """``fit_relaxation`` with tau on a grid of halves, as key, recovery_tau, recovery_cmin, recovery_r2 rounded."""
    taus = np.arange(TAU_LOW, TAU_HIGH + TAU_STEP / 2, TAU_STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full((b.num_rows, 3), np.nan)
            for i, ((px, py), level) in enumerate(zip(_points(b), b.column(base).to_numpy(zero_copy_only=False), strict=True)):
                if len(px) >= least and level > 0 and 0 <= py.min() <= level:
                    e = np.exp(-(px - px[0]) / taus[:, None])
                    r = py - level * (1 - e)
                    er, ee = (e * r).sum(axis=1), (e * e).sum(axis=1)
                    c = np.clip(er / ee, 0.0, level)
                    sse = (r * r).sum(axis=1) - 2 * c * er + c * c * ee
                    k, total = int(sse.argmin()), ((py - py.mean()) ** 2).sum()
                    r2 = 1 - sse[k] / total if total > 0 else 0.0
                    out[i] = (taus[k] if r2 >= R2_GATE else np.nan, c[k], r2)
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array(c, mask=np.isnan(c)) for c in out.T)], ["k", "tau", "cmin", "r2"])

    made = series_rows(rows, key, t, y, base).mapInArrow(run, f"k {rows.schema[key].dataType.simpleString()}, tau double, cmin double, r2 double")
    return made.select(F.col("k").alias(key), F.round("tau", 2).alias("recovery_tau"), F.round("cmin", 4).alias("recovery_cmin"), F.round("r2", 3).alias("recovery_r2"))
