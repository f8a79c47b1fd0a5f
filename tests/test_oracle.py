"""Every registered query against its SQL, value by value."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from prosegauge.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    expected = duck.sql(entry_points.oracle_sql()[name]).df()
    assert sorted(expected.columns) == columns
    assert rows(result.select(*columns).toPandas()) == rows(expected[columns])


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
