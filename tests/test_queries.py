"""Every query that SQL can state, against DuckDB on the smallest tables; the others must run and keep their columns."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(r[c] for c in columns) for r in df.collect()) if name in entry.oracle_sql() else df.count()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        names = want.columns
        assert sorted(names) == columns
        assert rows == Counter(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"ref_table", "ref_id", "state"}
