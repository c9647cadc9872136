"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert in_order(map(tuple, df.select(*names).collect())) == in_order(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["file_id", "path", "size", "mtime", "decision", "reason", "from_offset"]
    assert df.count() == 200


def test_sql_is_for_registered_queries_only():
    assert set(SQL) <= set(QUERIES)
