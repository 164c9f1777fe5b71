"""The tables on small hand-made sources that hold the edge cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.plans import models, questions
from marquee.plans.staging import (
    staged_item_text,
    staged_items,
    staged_list_entries,
    staged_ratings,
)
from marquee.plans.warehouse import Staged, marts_of
from marquee.sources import schemas


def raw_items(spark, items):
    names = schemas.ITEM_HEADERS
    defaults = {"Name": "n", "Type": "TV", "Genres": "a, b", "Source": "Manga", "Score": "7.0",
                "Members": "100", "Aired": "Apr 3, 2012", "Premiered": "Spring 2012",
                "Studios": "S", "Episodes": "12"}
    data = [tuple({**defaults, **item}.get(n) for n in names) for item in items]
    return spark.createDataFrame(data, schemas.ITEMS)


def test_staged_items_keep_the_missing_value_rules(spark):
    df = staged_items(raw_items(spark, [
        {"MAL_ID": 1, "Score": "Unknown", "Episodes": "12.0", "Source": "Unknown"},
        {"MAL_ID": 2, "Source": None, "Type": None, "Premiered": "Unknown", "Aired": "Unknown"},
        {"MAL_ID": 3, "Source": "Original", "Type": "ONA", "Members": "Unknown"},
        {"MAL_ID": 4, "Source": "Game", "Genres": "Unknown", "Score-10": "5.0"},
    ]))
    one, two, three, four = df.orderBy("item_id").collect()
    assert (one["score"], one["episodes"], one["source_category"]) == (None, 12, None)
    assert (two["source_category"], two["is_digital_native"]) == ("Other-IP", False)
    assert (two["season"], two["start_year"]) == (None, None)
    assert (three["source_category"], three["is_digital_native"]) == ("Original", True)
    assert (three["followers"], three["season"], three["start_year"]) == (None, "Spring", 2012)
    assert (four["tags"], four["score_10_count"]) == ("Unknown", 5.0)
    assert len(df.columns) == 37


def test_staged_facts(spark):
    ratings = spark.createDataFrame([(1, 1, r) for r in (0, 1, 10, 11, None)],
                                    "user_id int, anime_id int, rating int")
    assert sorted(r["rating"] for r in staged_ratings(ratings).collect()) == [1, 10]
    entries = spark.createDataFrame(
        [(1, 1, 5, s, 1) for s in (1, 2, 3, 4, 5, 6, None)],
        "user_id int, anime_id int, rating int, watching_status int, watched_episodes int")
    found = {r["status_code"]: r["status"] for r in staged_list_entries(entries).collect()}
    assert found == {1: "Watching", 2: "Completed", 3: "On Hold", 4: "Dropped", 5: "Unknown",
                     6: "Plan to Watch", None: "Unknown"}


def test_staged_text(spark):
    raw = spark.createDataFrame(
        [(1, "n", "8.1", "a", "two  words"), (2, "n", "Unknown", "a", "No synopsis yet"),
         (3, "n", None, None, None)], schemas.ITEM_TEXT)
    one, two, three = staged_item_text(raw).orderBy("item_id").collect()
    assert (one["has_text"], one["text_length"], one["text_words"]) == (True, 10, 3)
    assert (two["has_text"], two["text_words"], two["score"]) == (False, 0, None)
    assert (three["has_text"], three["text_length"]) == (False, None)


@pytest.fixture(scope="module")
def marts(spark):
    """Items 1..40; item 40 is rated and listed by nobody; user 9 lists but never rates."""
    items = [{"MAL_ID": i, "Members": str(i * 10) if i % 13 else "Unknown",
              "Genres": "a, b" if i % 2 else "a", "Aired": f"Apr 3, {2009 + i % 11}"}
             for i in range(1, 41)]
    facts = [(u, i, (u * i) % 10 + 1) for u in range(1, 9) for i in range(1, 40) if (u + i) % 3]
    entries = [(u, i, r, 2, 3) for u, i, r in facts]
    entries += [(u, i, 0, 4, 1) for u in range(1, 10) for i in range(1, 40, 5)]
    frames = {
        "items": raw_items(spark, items),
        "ratings": spark.createDataFrame(facts, schemas.RATINGS),
        "list_entries": spark.createDataFrame(entries, schemas.LIST_ENTRIES),
        "item_text": spark.createDataFrame(
            [(i, "n", "8.1", "a", "some words") for i in range(1, 30)], schemas.ITEM_TEXT),
    }
    return marts_of(Staged(frames.__getitem__))


def test_item_without_facts_keeps_null_stats(marts):
    row = marts.content.filter("item_id = 40").first()
    assert row["has_ratings"] is False
    assert (row["rating_count"], row["avg_rating"], row["completion_rate"]) == (None, None, None)
    assert row["has_text"] is None
    assert row["performance_score"] is not None


def test_followers_tier_puts_missing_followers_on_top(marts):
    tiers = {r["item_id"]: r["followers_tier"] for r in marts.item_stats.collect()}
    assert [tiers[i] for i in (13, 26, 39)] == ["Top 10%"] * 3
    assert tiers[1] == "Lower Half"


def test_user_profiles_hold_raters_only(marts):
    assert sorted(r["user_id"] for r in marts.users.select("user_id").collect()) == list(range(1, 9))
    row = marts.users.filter("user_id = 1").first()
    assert row["total_list_entries"] == row["completed_count"] + row["dropped_count"]
    assert row["rating_engagement_ratio"] == row["total_ratings"] / row["total_list_entries"]


def test_marts_have_their_columns(marts):
    assert marts.content.columns == models.CONTENT_COLUMNS
    assert marts.users.columns == models.USER_COLUMNS
    assert marts.tags.columns == models.TAG_COLUMNS
    assert (len(models.CONTENT_COLUMNS), len(models.USER_COLUMNS), len(models.TAG_COLUMNS)) == (
        35, 22, 17)


def test_score_formula(marts):
    import math

    row = marts.content.filter("item_id = 20").first()
    expected = (0.4 * (row["community_score"] - 1) / 9 + 0.3 * row["completion_rate"]
                + 0.2 * math.log(row["followers"]) / math.log(2_600_000)
                + 0.1 * (1 - row["drop_rate"]))
    assert row["performance_score"] == pytest.approx(expected)


def test_ranged_and_plain_ranking_build_the_same_marts(spark, marts, rows):
    text = spark.createDataFrame([(1, True, 2)], "item_id int, has_text boolean, text_words long")
    plain = models.content_performance(marts.item_stats, text)
    ranged = models.content_performance(marts.item_stats, text)
    columns = ["item_id", "score_rank", "popularity_rank", "completion_rank", "engagement_rank"]
    assert rows(ranged, *columns) == rows(plain, *columns)


@pytest.fixture(scope="module")
def stats_of(spark):
    def make(data):
        return spark.createDataFrame(
            [(i, tags, year, 7.0, 10, "Top 1%", 1, 7.0, 0.5, 0.1)
             for i, (tags, year) in enumerate(data)],
            "item_id int, tags string, start_year int, community_score double, followers int, "
            "followers_tier string, rating_count long, avg_rating double, completion_rate double, "
            "drop_rate double")
    return make


def test_tag_listed_twice_counts_once_but_weighs_twice(stats_of):
    stats = stats_of([("a, a", 2016), ("a", 2001), ("b", 2016)])
    row = models.tag_metrics(stats, min_items=2).collect()
    assert [(r["tag"], r["item_count"], r["total_followers"]) for r in row] == [("a", 2, 30)]
    assert row[0]["recent_ratio"] == pytest.approx(2 / 3)


def test_recent_ratio_counts_every_later_year(stats_of):
    row = models.tag_metrics(stats_of([("a", 2025), ("a", 2014), ("a", None)]), min_items=1).first()
    assert row["recent_ratio"] == pytest.approx(1 / 3)


def test_trend_classes_and_years_present(stats_of):
    data = []
    # growing: 1 a year before, 2 a year after, in one year each
    data += [("grow", 2010), ("grow", 2015), ("grow", 2015)]
    # declining: mean over the years present only
    data += [("fall", 2010)] * 4 + [("fall", 2012)] * 6 + [("fall", 2016)] * 3
    # no previous window: growth is unknown
    data += [("new", 2016)]
    # the bounds themselves are stable: +0.3 and -0.2
    data += [("up", 2010)] * 10 + [("up", 2015)] * 13
    data += [("down", 2010)] * 10 + [("down", 2015)] * 8
    # before the first trend year
    data += [("old", 1999)]
    stats = stats_of(data)
    found = {r["tag"]: r for r in models.tag_trends(
        models.tag_metrics(stats, min_items=1), stats).collect()}
    assert found["grow"]["trend_category"] == "Growing"
    assert (found["fall"]["prev_avg_count"], found["fall"]["trend_category"]) == (5.0, "Declining")
    assert (found["new"]["count_growth_rate"], found["new"]["trend_category"]) == (None, "Stable")
    assert found["up"]["trend_category"] == found["down"]["trend_category"] == "Stable"
    assert found["old"]["recent_avg_count"] is None


def test_segment_bounds_belong_to_the_upper_class(spark):
    data = [(1, 8.5, 500, 0.3), (2, 7.0, 100, 0.1), (3, 5.5, 30, 0.09), (4, 5.4, 29, None)]
    profiles = spark.createDataFrame(
        data, "user_id int, avg_rating double, unique_items_rated long, user_drop_rate double")
    for column in models.USER_COLUMNS:
        if column not in profiles.columns:
            profiles = profiles.withColumn(column, F.lit(1).cast("long"))
    found = [(r["rating_tendency"], r["viewing_diversity"], r["drop_tendency"])
             for r in models.user_segments(profiles).orderBy("user_id").collect()]
    assert found == [
        ("Generous", "Explorer", "High Dropper"),
        ("Moderate", "Regular Viewer", "Moderate Dropper"),
        ("Critical", "Selective", "Committed Viewer"),
        ("Very Critical", "Newcomer", "Committed Viewer"),
    ]


def test_forty_questions():
    books = (questions.CONTENT_QUESTIONS, questions.USER_QUESTIONS, questions.TAG_QUESTIONS)
    names = [name for book in books for name in book]
    assert len(names) == len(set(names)) == 40


def test_limits_break_ties_by_key(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (4, None)], "item_id int, m double")
    found = [r["item_id"] for r in questions.largest(df, "m", "item_id", 2).collect()]
    assert found == [1, 2]


def test_shares_sum_to_one_hundred(marts):
    total = questions.ub03(marts.users).agg(F.sum("pct")).first()[0]
    assert total == pytest.approx(100.0, abs=0.2)


def test_top_segment_keeps_the_sentinel_and_the_other_does_not(spark):
    df = spark.createDataFrame(
        [("Unknown", "Top 1%"), ("Unknown", "Lower Half"), ("a, b", "Top 1%"), (None, "Top 1%")],
        "tags string, followers_tier string")
    found = sorted(tuple(r) for r in questions.cm07(df).collect())
    assert found == [("Unknown", "Top 1%", 1), ("a", "All", 1), ("a", "Top 1%", 1),
                     ("b", "All", 1), ("b", "Top 1%", 1)]


def test_zero_episodes_have_no_band(spark):
    df = spark.createDataFrame(
        [(0, 7.0, 0.1), (1, 7.0, 0.1), (52, 7.0, 0.1), (53, 7.0, 0.1)],
        "episodes int, community_score double, completion_rate double")
    found = {r["episode_range"] for r in questions.cm06(df).collect()}
    assert found == {None, "1 ep (Movie/Special)", "27-52 eps (long)", "52+ eps (very long)"}
