"""The driver contract: entry() and every registered query against its oracle
SQL (DuckDB on the same parquet tables) at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from codecorpus.plans.oracle_sql import ORACLE
from codecorpus.plans.queries import QUERIES
from tests.conftest import SF_SMALL
from tools.check import TABLES, digest

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[0] == "threshold"


def test_every_library_query_has_an_oracle():
    iterative = {"search_trials", "search_best", "model_evaluation", "model_curve"}  # test_search.py
    assert set(QUERIES) - iterative == set(ORACLE) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.sql(E.oracle_sql()[key])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(res.columns, orows)[0]
