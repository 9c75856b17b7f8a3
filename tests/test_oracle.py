"""Every query with SQL gives the rows of that SQL."""

import math
import os

import pytest

from tesserae import queries as core

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return ("f", round(v, 5) + 0.0)
    return v if isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    df = core.queries()[name](spark, data)
    got = df.collect()
    result = db.execute(core.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted(repr([norm(r[c]) for c in order]) for r in got)
    b = sorted(repr([norm(r[columns.index(c)]) for c in order]) for r in want)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())
