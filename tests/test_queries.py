"""Every registered query against its SQL at the smallest scale, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    return None if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rows = con.sql(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in rows) and got
