"""Every query of the package that SQL can state, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from test_catalogue import TABLES, norm

from quillstone.llm import queries as Q


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, db, name):
    got, want = Q.queries()[name](spark, TABLES).toPandas(), db.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_two_thirds_of_the_rows_are_one_value(spark):
    """A hot value, common or not, comes out like any other."""
    from quillstone.llm import visual

    rows = [(f"a{i}", "n/a") for i in range(300)] + [(f"b{i}", "n/ a") for i in range(300)] + [(f"c{i}", f"Ｎet {i}") for i in range(50)] + [("d", "Net 7"), ("e", "É1"), ("f", "É1")]
    got = {r.id: (r.canonical, r.has_variant) for r in visual.one_form(spark.createDataFrame(rows, "id string, text string"), ["id"]).collect()}
    assert len(got) == len(rows) and {got[f"a{i}"] for i in range(300)} == {("n/a", False)} and {got[f"b{i}"] for i in range(300)} == {("n/ a", True)}
    assert got["c7"] == ("Net 7", True) and got["d"] == ("Net 7", False) and got["f"] == ("É1", True) and got["e"] == ("É1", False)
