"""The item, user and tag tables.  DataFrames in, DataFrame out; thresholds are parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import growth, known, ladder, ratio, unit_score
from marquee.operators.distribution import add_ranks
from marquee.operators.explode import explode_list
from marquee.operators.stats import (
    distinct_per_key,
    favourite,
    rating_counters,
    rating_measures,
    rating_stats,
    status_counters,
    status_profile,
    status_shares,
)
from marquee.sources.writers import Keep, unkept

# fixed values: share of the population below the rung, and its label
ITEM_TIERS = [(0.99, "Top 1%"), (0.95, "Top 5%"), (0.90, "Top 10%"), (0.50, "Upper Half")]
USER_TIERS = [(0.99, "Power"), (0.90, "Active"), (0.50, "Regular")]
POPULAR_TIERS = ["Top 1%", "Top 5%", "Top 10%"]

# fixed values: segment bounds
RATING_TENDENCY = [(8.5, "Generous"), (7.0, "Moderate"), (5.5, "Critical")]
VIEWING_DIVERSITY = [(500, "Explorer"), (100, "Regular Viewer"), (30, "Selective")]
DROP_TENDENCY = [(0.3, "High Dropper"), (0.1, "Moderate Dropper")]

# fixed values: year windows, growth bounds and scale of the scores
RECENT_YEARS = (2015, 2019)
PREVIOUS_YEARS = (2010, 2014)
FIRST_TREND_YEAR = 2000
GROWING_ABOVE = 0.3
DECLINING_BELOW = -0.2
MOST_FOLLOWERS = 2_600_000
MIN_ITEMS_PER_TAG = 10

_RATING_COLUMNS = [
    "rating_count", "avg_rating", "median_rating", "stddev_rating", "min_rating", "max_rating",
    "high_rating_ratio", "low_rating_ratio",
]


def item_stats(items: DataFrame, ratings: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per item: what is known of it, how it is rated, how it is watched.

    The facts are aggregated to item grain before they meet the items.
    """
    return item_stats_of(
        items, rating_counters(ratings, "item_id"), status_counters(entries, "item_id")
    )


def item_stats_of(items: DataFrame, rated: DataFrame, watched: DataFrame) -> DataFrame:
    """`item_stats` from the counters of ratings and statuses per item."""
    known_items = items.select(
        "item_id", "name", "type", "tags", "source_material", "source_category", "makers",
        F.col("score").alias("community_score"), "followers", "favorites", "start_year",
        "season", "episodes", "is_digital_native",
    )
    ranked = add_ranks(known_items, {"_place": ("percent_rank", "followers")})
    meta = ranked.withColumn(
        "followers_tier", ladder(F.col("_place"), ITEM_TIERS, "Lower Half")
    ).drop("_place")

    rated = rating_measures(rated, "item_id")
    watched = status_shares(watched)
    return (
        meta.join(rated, "item_id", "left")
        .join(watched, "item_id", "left")
        .select(
            *meta.columns,
            *_RATING_COLUMNS,
            F.col("entries").alias("total_list_count"),
            F.col("completed").alias("completed_users"),
            F.col("watching").alias("watching_users"),
            F.col("dropped").alias("dropped_users"),
            F.col("on_hold").alias("on_hold_users"),
            F.col("plan_to_watch").alias("plan_to_watch_users"),
            F.col("completed_share").alias("completion_rate"),
            F.col("dropped_share").alias("drop_rate"),
            F.col("plan_to_watch_share").alias("plan_rate"),
            F.col("rating_count").isNotNull().alias("has_ratings"),
        )
    )


def user_profiles(
    items: DataFrame, ratings: DataFrame, entries: DataFrame, *, keep: Keep = unkept
) -> DataFrame:
    """One row per user with at least one rating.

    ``keep`` is the cut point after the rating counts: the ranking reads them a second time.
    """
    rated = keep("user_ratings", _user_ratings(ratings))
    tiered = add_ranks(rated, {"_place": ("percent_rank", "total_ratings")}).withColumn(
        "user_tier", ladder(F.col("_place"), USER_TIERS, "Casual")
    )
    watched = status_profile(
        entries, "user_id", {"total_watched_episodes": F.sum("watched_episodes").cast("long")}
    )
    # made from two columns of a file, the tags of all items look small to Spark, which would broadcast them
    tagged = items.filter(known(F.col("tags"))).select("item_id", "tags").hint("merge")
    top_tags = favourite(ratings.join(tagged, "item_id"), "user_id", "tags")
    return (
        tiered.join(watched, "user_id", "left")
        .join(top_tags, "user_id", "left")
        .select(
            "user_id",
            "total_ratings",
            *[c for c in _RATING_COLUMNS if c != "rating_count"],
            "unique_items_rated",
            F.col("entries").alias("total_list_entries"),
            F.col("completed").alias("completed_count"),
            F.col("watching").alias("watching_count"),
            F.col("dropped").alias("dropped_count"),
            F.col("plan_to_watch").alias("plan_to_watch_count"),
            F.col("completed_share").alias("user_completion_rate"),
            F.col("dropped_share").alias("user_drop_rate"),
            "total_watched_episodes",
            F.col("tags").alias("most_watched_tags"),
            "user_tier",
        )
    )


def _user_ratings(ratings: DataFrame) -> DataFrame:
    stats = rating_stats(ratings, "user_id").withColumnRenamed("rating_count", "total_ratings")
    unique = distinct_per_key(ratings, "user_id", "item_id", "unique_items_rated")
    return (
        stats.withColumn("_user", F.struct("user_id"))
        .join(unique.select(F.struct("user_id").alias("_user"), "unique_items_rated"), "_user")
        .drop("_user")
    )


def tag_metrics(stats: DataFrame, *, min_items: int = MIN_ITEMS_PER_TAG) -> DataFrame:
    """One row per tag with enough items.

    The item count is of distinct items; means and shares are over listings, so a tag named twice
    by one item weighs twice.
    """
    listed = explode_list(stats, "tags", "tag")
    sizes = distinct_per_key(listed, "tag", "item_id", "item_count").filter(
        F.col("item_count") >= min_items
    )
    recent = F.col("start_year") >= RECENT_YEARS[0]
    means = listed.groupBy("tag").agg(
        F.avg("community_score").alias("avg_community_score"),
        F.avg("avg_rating").alias("avg_user_rating"),
        F.sum("followers").alias("total_followers"),
        F.avg("followers").alias("avg_followers"),
        F.avg("completion_rate").alias("avg_completion_rate"),
        F.avg("drop_rate").alias("avg_drop_rate"),
        F.min("start_year").alias("earliest_year"),
        F.max("start_year").alias("latest_year"),
        F.avg("rating_count").alias("avg_rating_count"),
        F.sum("rating_count").alias("total_ratings"),
        ratio(F.count_if(recent), F.count("*")).alias("recent_ratio"),
        ratio(F.count_if(F.col("followers_tier").isin(POPULAR_TIERS)), F.count("*"))
        .alias("popular_ratio"),
    )
    return sizes.join(means, "tag")


def content_performance(
    stats: DataFrame,
    text: DataFrame,
    *,
    most_followers: int = MOST_FOLLOWERS,
) -> DataFrame:
    """One row per item: quality, popularity, viewing, global ranks and the composite score."""
    ranked = add_ranks(
        stats,
        {
            "score_rank": ("rank_desc", "community_score"),
            "popularity_rank": ("rank_desc", "followers"),
            "completion_rank": ("rank_desc", "completion_rate"),
            "engagement_rank": ("rank_desc", "rating_count"),
        },
        key="item_id",
    )
    reach = F.ln(F.greatest(F.col("followers"), F.lit(1))) / math.log(most_followers)
    score = (
        0.4 * unit_score(F.col("community_score"))
        + 0.3 * F.coalesce(F.col("completion_rate"), F.lit(0.0))
        + 0.2 * reach
        + 0.1 * (1.0 - F.coalesce(F.col("drop_rate"), F.lit(0.0)))
    )
    notes = text.select("item_id", "has_text", "text_words")
    return (
        ranked.withColumn("performance_score", score)
        .join(notes, "item_id", "left")
        .select(CONTENT_COLUMNS)
    )


def user_segments(profiles: DataFrame, *, diversity=VIEWING_DIVERSITY) -> DataFrame:
    """One row per user with the three segment labels."""
    return profiles.withColumns({
        "rating_tendency": ladder(F.col("avg_rating"), RATING_TENDENCY, "Very Critical"),
        "viewing_diversity": ladder(F.col("unique_items_rated"), diversity, "Newcomer"),
        "drop_tendency": ladder(F.col("user_drop_rate"), DROP_TENDENCY, "Committed Viewer"),
        "rating_engagement_ratio": ratio(F.col("total_ratings"), F.col("total_list_entries")),
    }).select(USER_COLUMNS)


def yearly_tags(stats: DataFrame, *, first_year: int = FIRST_TREND_YEAR) -> DataFrame:
    """(tag, start_year): items listed and their mean score."""
    recent_items = stats.filter(F.col("start_year") >= first_year)
    return (
        explode_list(recent_items, "tags", "tag")
        .groupBy("tag", "start_year")
        .agg(F.count("*").alias("item_count"), F.avg("community_score").alias("avg_score"))
    )


def tag_trends(
    metrics: DataFrame,
    stats: DataFrame,
    *,
    recent=RECENT_YEARS,
    previous=PREVIOUS_YEARS,
    first_year: int = FIRST_TREND_YEAR,
) -> DataFrame:
    """One row per tag: growth between two windows of years, its class and a health score.

    A window's figure is the mean over the years in which the tag appears at all.
    """
    year = F.col("start_year")

    def mean_in(window, column):
        return F.avg(F.when(year.between(*window), F.col(column)))

    windows = yearly_tags(stats, first_year=first_year).groupBy("tag").agg(
        mean_in(recent, "item_count").alias("recent_avg_count"),
        mean_in(recent, "avg_score").alias("recent_avg_score"),
        mean_in(previous, "item_count").alias("prev_avg_count"),
        mean_in(previous, "avg_score").alias("prev_avg_score"),
    )
    change = F.col("count_growth_rate")
    previous_score = F.col("prev_avg_score")
    return (
        metrics.join(windows, "tag", "left")
        .withColumn(
            "count_growth_rate", growth(F.col("recent_avg_count"), F.col("prev_avg_count"))
        )
        .withColumn(
            "score_change",
            F.when(previous_score > 0, F.col("recent_avg_score") - previous_score),
        )
        .withColumn(
            "trend_category",
            F.when(change > GROWING_ABOVE, "Growing")
            .when(change < DECLINING_BELOW, "Declining")
            .otherwise("Stable"),
        )
        .withColumn(
            "tag_health_score",
            0.3 * F.col("recent_ratio")
            + 0.3 * unit_score(F.col("avg_community_score"))
            + 0.2 * F.col("popular_ratio")
            + 0.2 * F.col("avg_completion_rate"),
        )
        .select(TAG_COLUMNS)
    )


CONTENT_COLUMNS = [
    "item_id", "name", "type", "tags", "source_material", "source_category", "makers",
    "start_year", "season", "episodes", "is_digital_native",
    "community_score", "avg_rating", "median_rating", "stddev_rating", "high_rating_ratio",
    "low_rating_ratio",
    "followers", "followers_tier", "favorites", "rating_count",
    "completion_rate", "drop_rate", "plan_rate", "completed_users", "dropped_users",
    "watching_users",
    "has_text", "text_words", "has_ratings",
    "score_rank", "popularity_rank", "completion_rank", "engagement_rank", "performance_score",
]

USER_COLUMNS = [
    "user_id", "user_tier", "total_ratings", "unique_items_rated", "total_list_entries",
    "total_watched_episodes",
    "avg_rating", "stddev_rating", "median_rating", "high_rating_ratio", "low_rating_ratio",
    "completed_count", "watching_count", "dropped_count", "plan_to_watch_count",
    "user_completion_rate", "user_drop_rate", "most_watched_tags",
    "rating_tendency", "viewing_diversity", "drop_tendency", "rating_engagement_ratio",
]

TAG_COLUMNS = [
    "tag", "item_count", "avg_community_score", "avg_user_rating", "total_followers",
    "avg_followers", "avg_completion_rate", "avg_drop_rate", "total_ratings", "recent_ratio",
    "popular_ratio", "recent_avg_count", "prev_avg_count", "count_growth_rate", "score_change",
    "trend_category", "tag_health_score",
]
