"""Every text query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

from foliomill.llm.oracles import ORACLES
from foliomill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in ("books", "chapters", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(rows[0].asDict())
    assert sorted((tuple(r[n] for n in names) for r in rows), key=repr) == sorted(cur.fetchall(), key=repr)
