"""Every core query against its SQL on the smallest tables."""

import glob
import importlib
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import CORE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = [importlib.import_module(f"lectern.plans.{m}") for m in CORE]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame):
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return f"{x:.5f}" if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
