from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from marquee.llm import queries
from tests.conftest import SMALL
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in queries.all_queries()}
    assert numbers == set(range(1, 14))
    assert {*queries.all_queries(), "pipeline"} <= set(entry.queries())
    assert set(queries.all_sql()) <= set(queries.all_queries())


@pytest.mark.parametrize("name", list(queries.all_sql()))
def test_same_rows(spark, con, name):
    good, note, _ = compare(spark, con, name, SMALL, queries.all_queries()[name], queries.all_sql()[name])
    assert good, note


def test_sharding_stays_in_the_jvm(spark):
    plan = queries.op6_hash_tree(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
