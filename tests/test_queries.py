"""Every query that has SQL against DuckDB over the smallest tables; the others must run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import native, pipeline, relational

MODS = (relational, native, pipeline)
QUERIES = {k: f for m in MODS for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODS for k, q in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def value(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 9))
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df):
    cols = sorted(df.columns)
    return sorted(zip(*[[value(x) for x in df[c].astype(object)] for c in cols])), cols


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    if name in SQL:
        assert rows(got.toPandas()) == rows(duck.sql(SQL[name]).df())
    else:
        assert got.columns and got.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_pushdown(spark, sf):
    """Filters and columns reach the scan."""
    plan = relational.QUERIES["pk_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan and "o_orderdate" not in plan
