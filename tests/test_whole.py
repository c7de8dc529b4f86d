"""The queries over whole tables, without SQL, against plain loops."""

import hashlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from terrashift import catalog
from terrashift.operators import recovery as R

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def series_dir(spark, tmp_path_factory):
    """Smiling, flat and noisy series, of users on both sides of id 40."""
    r, rows = np.random.default_rng(3), []
    for u in (0, 7, 39, 40, 41, 120):
        for d in range(30):
            if (d + u) % 11 != 5:
                noise = r.normal() * (0 if u == 40 else 15 if u in (41, 7) else 0.02)
                rows.append((u, datetime(2024, 1, 1, 12) + timedelta(days=d), 50.0 + (0.05 * (d - (12 if u == 0 else 16)) ** 2 if u != 39 else 0.0) + noise))
    path = str(tmp_path_factory.mktemp("series"))
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.mode("overwrite").parquet(f"{path}/events.parquet")
    return path


def post(spark, path):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{path}/events.parquet").collect():
        out[r.user_id].append(((r.ts - datetime(2024, 1, 1)).days, r.value))
    return {u: sorted(v) for u, v in out.items()}


def after_event(rows):
    return [(float(d - 8), y) for d, y in rows if d >= 8]


def curvature(t, y, w):
    t, y, w = (np.asarray(v, float) for v in (t, y, w))
    return float(np.linalg.lstsq(np.stack([t * t, t, np.ones(len(t))], 1) * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]) * 1e4


def test_bootstrap_covers_every_user(spark, series_dir):
    got = {r.user_id: (r.ci_lower, r.ci_upper) for r in QUERIES["st04_bootstrap_whole"](spark, series_dir).collect()}
    rows = post(spark, series_dir)
    assert set(got) == set(rows) == {0, 7, 39, 40, 41, 120}
    for u, points in rows.items():
        t, y = zip(*after_event(points))
        fits = []
        for b in range(R.BOOTSTRAPS):
            w = [int(hashlib.md5(f"{b}-{i}".encode()).hexdigest()[:4], 16) % 3 for i in range(len(t))]
            fits.append(curvature(t, y, w))
        assert np.allclose(got[u], np.percentile(fits, [2.5, 97.5]), rtol=1e-5, atol=2e-3)


def test_regression_over_every_day(spark, series_dir):
    got = {r.user_id: r.regressed for r in QUERIES["win15_regression_whole"](spark, series_dir).collect()}
    want = {}
    for u, points in post(spark, series_dir).items():
        x = dict(points)
        want[u] = any(d in x and d - 1 in x and x[d] < x[d - 1] for d in range(1, 30))
    assert got == want


def test_mart_and_left_join_over_every_key(spark, small_dir):
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_discount", "l_quantity", "l_tax").collect()
    parts = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{small_dir}/part.parquet").collect()}
    by = defaultdict(list)
    for r in lines:
        by[r.l_partkey, str(r.l_shipdate.year)].append(r)
    got = QUERIES["jn04_star_mart_whole"](spark, small_dir).collect()
    assert {(r.parcel_idx, r.observation_date) for r in got} == {k for k in by if k[0] in parts} | {(p, None) for p in parts if not any(k[0] == p for k in by)}
    for r in got:
        assert r.chm_max == parts[r.parcel_idx]
        if r.observation_date:
            rows = by[r.parcel_idx, r.observation_date]
            assert r.vv_change_db == pytest.approx(-100 * np.mean([float(x.l_tax) for x in rows]), abs=2e-6) and r.dnbr == pytest.approx(8 * np.mean([float(x.l_discount) for x in rows]), abs=2e-6)
    wide = {r.parcel_idx: r.ndvi_1996 for r in QUERIES["mart_ndvi_series_whole"](spark, small_dir).collect()}
    assert set(wide) == {k[0] for k in by}
    assert all(wide[p] == pytest.approx(np.mean([float(x.l_quantity) for x in by[p, "1996"]]) / 50, abs=2e-6) for p in wide if (p, "1996") in by)
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{small_dir}/customer.parquet").collect()}
    want = {r.o_orderkey: names.get(r.o_custkey) for r in spark.read.parquet(f"{small_dir}/orders.parquet").collect()}
    assert {r.o_orderkey: r.c_name for r in QUERIES["jn01_left_whole"](spark, small_dir).collect()} == want


def test_gate_is_the_lower_limit(spark, series_dir):
    rows, want, point = post(spark, series_dir), {}, {}
    for u, points in rows.items():
        t, y = (np.array(v) for v in zip(*after_event(points)))
        n = len(t)
        rng = np.random.default_rng(R.SEED)
        fits = [curvature(t, y, np.bincount(rng.choice(n, n, replace=True), minlength=n)) for _ in range(R.BOOTSTRAPS)]
        want[u] = bool(n >= 10 and np.percentile(fits, 2.5) >= R.CI_LOWER_GATE)
        point[u] = bool(n >= 10 and curvature(t, y, np.ones(n)) >= R.CI_LOWER_GATE)
    assert any(point[u] and not want[u] for u in want)
    assert {r.user_id: r.smile_valid for r in QUERIES["st05_gate_bootstrap"](spark, series_dir).collect()} == want
    got = {r.user_id: r for r in QUERIES["st08_recovery_bootstrap"](spark, series_dir).collect()}
    assert {u: r.smile_valid for u, r in got.items()} == want
    assert all(r.recovery_months_post_fire is None for u, r in got.items() if not want[u])
    assert any(r.recovery_months_post_fire is not None for r in got.values())
