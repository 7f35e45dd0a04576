"""Every query with SQL, both engines side by side on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for n in TABLES.split():
        c.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = entry.QUERIES[name](spark, sf)
    want = con.sql(entry.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) <= 2e-5 * max(1, abs(q)) for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
