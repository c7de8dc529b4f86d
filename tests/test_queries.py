"""Every query against its SQL over the smallest tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

from terrashift import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ in ("Decimal", "float") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(small_dir):
    import duckdb

    con = duckdb.connect()
    for f in Path(small_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = ordered(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["st04_bootstrap_seeded", "fn_simplify", "st16_importance", "st17_pca_kmeans", "st14_classifier"])
def test_has_rows(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).count() > 0
