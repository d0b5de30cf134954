"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sieveworks.plans import registry

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from '{table}'")
    return connection


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{value:.6f}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    rows = sorted((tuple(shown(v) for v in row) for row in got.select(*columns).collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        return
    relation = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    wanted = relation.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert rows == sorted((tuple(shown(v) for v in row) for row in wanted), key=repr)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
