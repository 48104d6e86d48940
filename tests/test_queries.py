"""Every query with SQL against DuckDB, on the smallest test data."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = collections.Counter(repr(tuple(r)) for r in df.select(*columns).collect())
    result = oracle.execute(SQL[name])
    theirs_columns = [c[0] for c in result.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    assert ours == collections.Counter(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
