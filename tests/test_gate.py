"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
CORE = sorted(set(entry._core.oracle_sql()))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(ROOT):
        con.execute(f"create view {name.split('.')[0]} as select * from '{ROOT}/{name}'")
    return con


def same_rows(spark, sql, name, query, text):
    df = query(spark, ROOT)
    got = [tuple(r) for r in df.collect()]
    found = sql.execute(text)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, sql, name):
    same_rows(spark, sql, name, entry._core.queries()[name], entry._core.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
