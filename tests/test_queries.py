"""Every query with SQL against DuckDB on the smallest tables."""
import math
import os
from collections import Counter

import duckdb
import pytest

from lakeseek.queries import indexing, problems, retrieval

FOLDER = "/root/testdata/sf0.001"
QUERIES = problems.QUERIES | retrieval.QUERIES | indexing.QUERIES
SQL = problems.SQL | retrieval.SQL | indexing.SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(plain(tuple(r)) for r in df.select(*columns).collect())
    found = duck.sql(SQL[name])
    order = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == Counter(plain(tuple(r[i] for i in order)) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).collect() is not None
