"""Every registered query on the smallest tables against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else repr(round(float(value), 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in order) for row in df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
