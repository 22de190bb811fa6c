"""Every registered query against its SQL on the smallest data, and the flagship query."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want


def test_flagship(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
