"""Every query against its SQL on the smallest tables, and the rest for its rows."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: str([(x is None, x) for x in r]))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    mine = [tuple(plain(r[c]) for c in columns) for r in frame.collect()]
    result = con.execute(SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    theirs = [tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall()]
    assert ordered(mine) == ordered(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
