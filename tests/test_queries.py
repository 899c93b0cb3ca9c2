"""Every core query that has SQL agrees with DuckDB on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from foliomill import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "books chapters chapter_refs pages images documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return (v.astimezone(dt.UTC) if v.tzinfo else v).replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", list(core.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(core.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [q for q in core.QUERIES if q not in core.ORACLES])
def test_query_runs(spark, name):
    df = core.QUERIES[name](spark, DATA)
    assert df.columns and isinstance(df.collect(), list)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
