"""Every raster query that has SQL against DuckDB, over sf0.001."""

import math

import duckdb
import pytest

from rasterloom.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{DIR}/orders.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    have = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    assert have == want
