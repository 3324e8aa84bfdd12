"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillstone.plans import catalog

TABLES = "/root/testdata/sf0.001"


def norm(df):
    def f(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted(map(repr, (tuple(f(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    got, want = entry.queries()[name](spark, TABLES).toPandas(), db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_contract(spark, db):
    assert set(catalog.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
