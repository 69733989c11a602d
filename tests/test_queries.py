"""Every query with SQL against DuckDB, and the others against plain loops, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quirefold.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(df):
    df = df[sorted(df.columns)].astype(object)

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{float(v) + 0.0:.6f}"
        return str(pd.Timestamp(v)) if isinstance(v, (pd.Timestamp, np.datetime64)) or hasattr(v, "isoformat") else str(v)

    return df.map(text).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf, duck, name):
    got, want = norm(registry.QUERIES[name](spark, sf).toPandas()), norm(duck.sql(registry.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_entry_works_without_llm():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.SQL) <= set(__spark_entry__.oracle_sql())


def _series(spark, sf):
    from quirefold.plans import lab_queries

    out = {}
    for r in lab_queries._exact(spark, sf).collect():
        out.setdefault(r.series_id, {})[r.n] = int(r.num)
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def _exact(rows):
    from fractions import Fraction

    out = {}
    for r in rows:
        out.setdefault(r.series_id, {})[r.n] = Fraction(int(r.num), int(r.den))
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def _times(a, b):
    return [sum(a[i] * b[n - i] for i in range(n + 1)) for n in range(len(a))]


def test_inverse_by_residual(spark, sf):
    f, inv = _series(spark, sf), _exact(registry.QUERIES["series_inverse"](spark, sf).collect())
    assert set(inv) == set(f)
    for k, c in f.items():
        assert _times(c, inv[k]) == [1] + [0] * (len(c) - 1)


def test_laplace_against_long_sum(spark, sf):
    t = np.linspace(0, 60, 60001)
    for r in registry.QUERIES["laplace_sum"](spark, sf).dropDuplicates(["l_tax"]).collect():
        y = np.exp(-t) / (1 + (r.l_tax + 0.01) * t)
        assert abs(r.value - ((y[1:] + y[:-1]) / 2 * np.diff(t)).sum()) < 1e-6


def test_fragment_index(spark, sf):
    rows = registry.QUERIES["fragment_index"](spark, sf).collect()
    assert rows and len({r.id for r in rows}) == len(rows) and all(r.n_tokens >= 20 for r in rows)
