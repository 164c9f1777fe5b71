from __future__ import annotations

import statistics

from pyspark.sql import functions as F

from marquee.operators.stats import (
    distinct_per_key,
    favourite,
    rating_stats,
    status_profile,
)


def test_rating_stats_equal_the_textbook(spark):
    given = {1: [7], 2: [1, 10], 3: [8, 8, 9, 4, 2], 4: [5] * 9, 5: [1, 2, 3, 4]}
    df = spark.createDataFrame([(k, r) for k, rs in given.items() for r in rs], "k int, rating int")
    for r in rating_stats(df, "k").collect():
        rated = given[r["k"]]
        assert r["rating_count"] == len(rated)
        assert r["avg_rating"] == statistics.mean(rated)
        assert r["median_rating"] == statistics.median(rated)
        assert (r["min_rating"], r["max_rating"]) == (min(rated), max(rated))
        assert r["high_rating_ratio"] == sum(x >= 8 for x in rated) / len(rated)
        assert r["low_rating_ratio"] == sum(x <= 4 for x in rated) / len(rated)
        if len(rated) == 1:
            assert r["stddev_rating"] is None
        else:
            assert abs(r["stddev_rating"] - statistics.stdev(rated)) < 1e-12


def test_rating_stats_of_a_hot_key_shuffle_one_row_per_task(spark):
    """Whatever a key holds, a task sends ten counters for it."""
    df = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 10 + 1).cast("int").alias("rating"),
    )
    stats = rating_stats(df, "k")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan
    assert "ObjectHashAggregate" not in plan
    hot = stats.filter("k = 0").first()
    assert hot["rating_count"] == 10000


def test_status_profile(spark):
    df = spark.createDataFrame(
        [(1, "Completed"), (1, "Dropped"), (1, "Unknown"), (1, "Completed"), (2, "On Hold")],
        "k int, status string")
    one, two = status_profile(df, "k").orderBy("k").collect()
    assert (one["entries"], one["completed"], one["dropped"]) == (4, 2, 1)
    assert (one["completed_share"], one["dropped_share"]) == (0.5, 0.25)
    assert (two["on_hold"], two["plan_to_watch_share"]) == (1, 0.0)


def test_distinct_ignores_null_but_keeps_the_key(spark, rows):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, None)], "k int, v int")
    assert rows(distinct_per_key(df, "k", "v", "n")) == [(1, 2), (2, 0)]


def test_favourite_breaks_ties_by_value(spark, rows):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (2, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert rows(favourite(df, "k", "v")) == [(1, "a"), (2, "y")]
