from __future__ import annotations

from pyspark.sql import functions as F

from marquee.plans import quality, registry
from marquee.plans.warehouse import Marts
from tests.conftest import SMALL


def verdicts(df):
    return {r["column_name"]: (r["failing_rows"], r["passed"]) for r in df.collect()}


def test_unique_counts_repeated_values_not_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert verdicts(quality.unique(df, "t", "k")) == {"k": (1, False)}


def test_unique_passes_on_nothing(spark):
    assert verdicts(quality.unique(spark.createDataFrame([], "k int"), "t", "k")) == {"k": (0, True)}


def test_not_null_checks_all_columns_in_one_pass(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    found = quality.not_null(df, "t", ["a", "b"])
    assert verdicts(found) == {"a": (1, False), "b": (2, False)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_accepted_values_let_null_pass(spark):
    df = spark.createDataFrame([("TV",), ("Radio",), (None,)], "type string")
    assert verdicts(quality.accepted_values(df, "t", {"type": ["TV"]})) == {"type": (1, False)}


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert verdicts(quality.orphans(child, parent, "t", "k")) == {"k": (2, False)}


def test_out_of_range_names_the_value(spark, rows):
    df = spark.createDataFrame(
        [(1, 1.1, 0.0, 0.5, 5.0), (2, None, -0.1, 1.0, 10.5), (3, 0.0, 1.0, None, 1.0)],
        "item_id int, completion_rate double, drop_rate double, performance_score double, "
        "community_score double")
    assert rows(quality.out_of_range(df)) == [
        ("community_score", 2, 10.5), ("completion_rate", 1, 1.1), ("drop_rate", 2, -0.1)]


def test_more_ratings_than_entries(spark, rows):
    df = spark.createDataFrame([(1, 5, 4), (2, 4, 4), (3, None, 1), (4, 3, None)],
                               "item_id int, rating_count long, total_list_count long")
    assert rows(quality.more_ratings_than_entries(df)) == [(1, 5, 4)]


def test_all_row_checks_of_a_table_are_one_pass(spark):
    """Twenty-two row-level checks on ten tables, eight keys and four relationships."""
    staged, built = registry.staged(spark, SMALL), registry.marts(spark, SMALL)
    plan = quality.all_checks(staged, built)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("inline(") == len(quality.REQUIRED)


def test_orphans_are_looked_for_in_tables_made_side_by_side(spark, monkeypatch):
    """The users do not wait for the items: all tables are asked for at once."""
    asked = []
    make_all = Marts.make_all
    monkeypatch.setattr(Marts, "make_all", lambda self: asked.append(1) or make_all(self))
    for name in ("quality_orphans", "quality_unique", "quality_not_null"):
        registry.quality_queries()[name](spark, SMALL)
    assert len(asked) == 3
