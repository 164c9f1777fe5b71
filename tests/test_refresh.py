"""Refresh from kept counters, facts laid out by key, sketches, checks taken while writing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.plans import models, profiling, quality, refresh, sketches
from marquee.plans.patterns import table_sample
from marquee.plans.registry import staged
from marquee.plans.warehouse import facts_by_key, marts_of
from marquee.sources.writers import Shelf
from tests.conftest import SMALL


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_old_state_and_new_rows_equal_the_full_build(spark, rows, tmp_path):
    s = staged(spark, SMALL)
    new = F.col("user_id") % 3 == 0
    old = refresh.state_of(s.ratings.filter(~new), s.entries.filter(~new))
    shelf = Shelf(spark, "refresh")
    kept = refresh.ItemState(shelf("old_r", old.ratings), shelf("old_s", old.statuses))
    state = refresh.refreshed(kept, s.ratings.filter(new), s.entries.filter(new))
    full = models.item_stats(s.items, s.ratings, s.entries)
    assert rows(refresh.item_stats_from(s.items, state), *full.columns) == rows(full)
    plain = {r["item_id"]: (r["rating_count"], r["avg_rating"])
             for r in profiling.activity(s.ratings, "item_id").collect()}
    found = {r["item_id"]: (r["rating_count"], r["avg_rating"])
             for r in refresh.activity_from(state).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in plain.items()}
    assert {k: v[1] for k, v in found.items()} == pytest.approx({k: v[1] for k, v in plain.items()})


def test_a_refresh_does_not_scan_the_old_facts(spark, tmp_path):
    s = staged(spark, SMALL)
    shelf = Shelf(spark, "refresh without old facts")
    old = refresh.state_of(s.ratings, s.entries)
    kept = refresh.ItemState(shelf("r", old.ratings), shelf("s", old.statuses))
    slices = str(tmp_path / "slice")
    s.ratings.limit(9).write.parquet(slices + "_r")
    s.entries.limit(9).write.parquet(slices + "_e")
    state = refresh.refreshed(kept, spark.read.parquet(slices + "_r"), spark.read.parquet(slices + "_e"))
    for part in state:
        assert "lineitem" not in executed(part)
        assert "lineitem" not in str(part.inputFiles())


def test_facts_by_key_reach_the_item_table_without_a_shuffle(spark, rows):
    s = staged(spark, SMALL)
    facts = facts_by_key(s, "item_id", "plan_facts", buckets=4)
    for fact in (facts.ratings, facts.entries):
        grouped = fact.groupBy("item_id").count()
        assert "Exchange" not in executed(grouped)
    stats = models.item_stats(s.items, facts.ratings, facts.entries)
    plan = executed(stats)
    # nothing stands between the scan of a fact and its aggregate
    for table in ("plan_facts_ratings_by_item_id", "plan_facts_entries_by_item_id"):
        above = plan[:plan.index(table)].split("HashAggregate")[-1]
        assert "Exchange" not in above
    assert rows(stats) == rows(models.item_stats(s.items, s.ratings, s.entries))
    again = facts_by_key(s, "item_id", "plan_facts")
    assert again.ratings.count() == s.ratings.count()


def test_sketches_of_slices_are_united(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7000).alias("v"))
    slices = [sketches.distinct_sketches(df.filter(F.col("v") % 2 == i), ["k"], "v") for i in (0, 1)]
    found = sketches.distinct_counts(sketches.united_distinct(slices, ["k"]), "n").collect()
    exact = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    for row in found:
        assert row["n"] == pytest.approx(exact[row["k"]], rel=3 * sketches.DISTINCT_ERROR)
    slices = [sketches.quantile_sketches(df.filter(F.col("v") % 2 == i), ["k"], "v") for i in (0, 1)]
    for row in sketches.quantile_values(sketches.united_quantiles(slices, ["k"]), [0.1, 0.9]).collect():
        assert row["n"] == 20_000
        for point in (0.1, 0.9):
            slack = 2 * sketches.RANK_ERROR
            assert abs(row[f"p{format(point * 100, 'g')}"] / 7000 - point) <= slack


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([("a", None)], "k string, v double")
    assert sketches.quantile_sketches(none, ["k"], "v").count() == 0
    assert sketches.distinct_counts(sketches.distinct_sketches(none, ["k"], "v"), "n").first()["n"] == 0


def test_checks_taken_while_writing_equal_scans(spark, rows):
    s = staged(spark, SMALL)
    shelf = quality.CheckedShelf(spark, "checked")
    m = marts_of(s, shelf).make_all()
    assert set(shelf.failures) == {"item_stats", "user_profiles", "tag_metrics", "content", "users", "tags"}
    assert rows(quality.all_checks(s, m, shelf.failures)) == rows(quality.all_checks(s, m))
    broken = m.item_stats.withColumn("rating_count", F.lit(10**9)).withColumn("total_list_count", F.lit(1))
    shelf = quality.CheckedShelf(spark, "broken")
    written = shelf("item_stats", broken)
    seen = quality.row_checks(written, "item_stats", quality._checks_of("item_stats")).collect()
    assert [r["failing_rows"] for r in seen] == list(shelf.failures["item_stats"].values())
    assert max(r["failing_rows"] for r in seen) == written.count()


def test_tags_as_bitmaps_count_like_pairs(spark):
    tags = [", ".join(f"tag{(i * 7 + j * j) % 150}" for j in range(i % 6)) or None for i in range(300)]
    items = spark.createDataFrame(list(enumerate(tags)), "item_id int, tags string")
    ratings = spark.range(5000).selectExpr("id % 40 as user_id", "cast(id * 13 % 300 as int) as item_id")
    expected = {}
    for user, item in {(i % 40, i * 13 % 300) for i in range(5000)}:
        if tags[item]:
            expected.setdefault(user, set()).update(tags[item].split(", "))
    found = {r["user_id"]: r["tag_count"] for r in profiling.tag_diversity(ratings, items).collect()}
    assert found == {user: len(t) for user, t in expected.items()}


def test_a_busy_user_is_united_before_the_shuffle(spark):
    s = staged(spark, SMALL)
    plan = executed(profiling.tag_diversity(s.ratings, s.items))
    assert "partial_bit_or" in plan
    assert "partial_count(distinct" not in plan


def test_the_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    first = table_sample(df.repartition(7), "id").collect()
    assert first == table_sample(df.coalesce(1), "id").collect()
    assert len(first) == 5
    assert "TakeOrderedAndProject" in executed(table_sample(df, "id"))
