"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from marquee.plans import registry
from oracle.registry import all_sql
from tests.conftest import SMALL
from tools.check import TABLES, compare

QUERIES, STATEMENTS = registry.all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def test_every_statement_has_a_query():
    assert set(STATEMENTS) == set(QUERIES)


def test_all_are_registered():
    assert QUERIES.keys() <= entry.queries().keys()
    assert STATEMENTS.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    good, note, _ = compare(spark, con, name, SMALL, QUERIES[name], STATEMENTS.get(name))
    assert good, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 20
    assert "performance_score" in df.columns
