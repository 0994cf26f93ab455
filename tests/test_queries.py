"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from gristmill.plans import QUERIES, SQL
from gristmill.session import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(list(map(plain, value))) if isinstance(value, (list, tuple)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(row[k]) for k in order) for row in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    said = duck.execute(SQL[name])
    names = [c[0] for c in said.description]
    assert sorted(out.columns) == sorted(names)
    assert rows(out.columns, map(tuple, out.collect())) == rows(names, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    first, again = (QUERIES[name](spark, FOLDER) for _ in range(2))
    assert rows(first.columns, map(tuple, first.collect())) == rows(again.columns, map(tuple, again.collect()))
