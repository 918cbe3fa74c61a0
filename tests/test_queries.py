"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import re

import duckdb
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, db, name):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = db.sql(sql)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_longest_spans_has_all_items(spark, small, db):
    words = lambda sql: {w for (t,) in db.sql(sql).fetchall() for w in re.findall("[a-z0-9]+", (t or "").lower())}
    keys = {w for w in words("select text from benchmark") if len(w) >= 4}
    got = {r.key for r in catalog.queries()["longest_spans"](spark, small).select("key").distinct().collect()}
    assert keys & words("select text from documents") <= got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
