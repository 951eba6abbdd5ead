import os
from collections import Counter

import duckdb
import pytest

from lakeseek.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.sql(queries.SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
