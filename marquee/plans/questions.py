"""The forty questions.  Each takes the content, user or tag table and returns its answer.

Every limited answer has a total order: rows that tie on the question's measure are taken by key.
Means are rounded as the question asks, half away from zero on the binary value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import known, ladder, round_mean, round_to
from marquee.operators.explode import pieces

ITEM, USER, TAG = "item_id", "user_id", "tag"

CONTENT_QUESTIONS: dict[str, Callable[..., DataFrame]] = {}
USER_QUESTIONS: dict[str, Callable[..., DataFrame]] = {}
TAG_QUESTIONS: dict[str, Callable[..., DataFrame]] = {}


def _about(book: dict[str, Callable[..., DataFrame]]):
    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        book[function.__name__] = function
        return function

    return register


content, users, tags = _about(CONTENT_QUESTIONS), _about(USER_QUESTIONS), _about(TAG_QUESTIONS)


def largest(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), F.asc(key)).limit(k)


def mean(column: str, digits: int, alias: str) -> Column:
    return round_mean(F.avg(column), digits).alias(alias)


def count(alias: str) -> Column:
    return F.count("*").alias(alias)


def with_share(grouped: DataFrame, n: str, into: str) -> DataFrame:
    """Percentage of the sum of a count, for the few rows of a grouping by labels.

    The grouped rows meet in one task, so that the facts below are read once.
    """
    total = F.sum(n).over(Window.partitionBy())
    return grouped.withColumn(into, F.col(n) * 100.0 / total)


# --- content performance -------------------------------------------------------------------


@content
def cp01(c: DataFrame, k: int = 10) -> DataFrame:
    """Best community scores."""
    scored = c.filter(F.col("community_score").isNotNull())
    return largest(scored, "community_score", ITEM, k).select(
        "name", "type", "community_score", "followers", "tags"
    )


@content
def cp02(c: DataFrame, k: int = 10, min_followers: int = 1000) -> DataFrame:
    """TV items most often completed, among those with enough followers."""
    eligible = c.filter(
        (F.col("type") == "TV")
        & F.col("completion_rate").isNotNull()
        & (F.col("followers") >= min_followers)
    )
    return largest(eligible, "completion_rate", ITEM, k).select(
        "name", "community_score", "completion_rate", "drop_rate", "followers"
    )


@content
def cp03(c: DataFrame, k: int = 10, min_followers: int = 1000) -> DataFrame:
    """Items most often dropped, with their score."""
    eligible = c.filter(F.col("drop_rate").isNotNull() & (F.col("followers") >= min_followers))
    return largest(eligible, "drop_rate", ITEM, k).select(
        "name", "type", "drop_rate", "community_score", "followers", "completion_rate"
    )


@content
def cp04(c: DataFrame, k: int = 20) -> DataFrame:
    """Best composite scores."""
    scored = c.filter(F.col("performance_score").isNotNull())
    return largest(scored, "performance_score", ITEM, k).select(
        "name", "type", "performance_score", "community_score", "completion_rate", "drop_rate",
        "followers", "followers_tier",
    )


@content
def cp05(c: DataFrame) -> DataFrame:
    """Adapted against original works."""
    return (
        c.filter(F.col("source_category").isNotNull())
        .groupBy("source_category")
        .agg(
            count("item_count"),
            mean("community_score", 3, "avg_score"),
            mean("completion_rate", 3, "avg_completion_rate"),
            mean("drop_rate", 3, "avg_drop_rate"),
            mean("followers", 0, "avg_followers"),
        )
        .orderBy(F.desc_nulls_last("avg_score"), "source_category")
    )


@content
def cp06(c: DataFrame, min_followers: int = 100_000, min_drop: float = 0.10) -> DataFrame:
    """Popular items that many viewers drop."""
    return (
        c.filter((F.col("followers") >= min_followers) & (F.col("drop_rate") >= min_drop))
        .orderBy(F.desc("drop_rate"), ITEM)
        .select("name", "type", "followers", "drop_rate", "community_score", "tags")
    )


@content
def cp07(c: DataFrame, types: tuple[str, ...] = ("ONA", "TV")) -> DataFrame:
    """Web releases against TV."""
    return c.filter(F.col("type").isin(*types)).groupBy("type").agg(
        count("item_count"),
        mean("community_score", 3, "avg_score"),
        mean("completion_rate", 3, "avg_completion_rate"),
        mean("drop_rate", 3, "avg_drop_rate"),
    )


@content
def cp08(c: DataFrame) -> DataFrame:
    """Items with, without and outside the text file."""
    return c.groupBy("has_text").agg(
        count("item_count"),
        mean("followers", 0, "avg_followers"),
        mean("community_score", 3, "avg_score"),
    )


@content
def cp09(c: DataFrame, k: int = 15) -> DataFrame:
    """Tag combinations of the most followed items."""
    grouped = (
        c.filter(F.col("followers_tier") == "Top 1%")
        .groupBy("tags")
        .agg(
            mean("community_score", 3, "avg_score"),
            mean("completion_rate", 3, "avg_completion_rate"),
            count("item_count"),
            count("combination_count"),
        )
    )
    return largest(grouped, "combination_count", "tags", k)


@content
def cp10(c: DataFrame, years: tuple[int, int] = (2010, 2019), top: int = 50,
         k: int = 15) -> DataFrame:
    """Who made the best items of a decade."""
    decade = c.filter(
        F.col("start_year").between(*years) & F.col("performance_score").isNotNull()
    )
    best = largest(decade, "performance_score", ITEM, top)
    by_maker = best.groupBy("makers").agg(
        count("item_count"), mean("performance_score", 3, "avg_performance")
    )
    return largest(by_maker, "item_count", "makers", k)


# --- user behaviour ------------------------------------------------------------------------


@users
def ub01(u: DataFrame) -> DataFrame:
    """Users and ratings per activity tier."""
    return u.groupBy("user_tier").agg(
        count("user_count"),
        mean("avg_rating", 3, "avg_rating"),
        mean("total_ratings", 0, "avg_total_ratings"),
    ).orderBy(F.desc("avg_total_ratings"), "user_tier")


@users
def ub02(u: DataFrame, tier: str = "Power") -> DataFrame:
    """The most active tier against everyone else."""
    group = F.when(F.col("user_tier") == tier, tier).otherwise("Others")
    return u.groupBy(group.alias("user_group")).agg(
        count("user_count"),
        mean("avg_rating", 3, "avg_rating"),
        mean("total_ratings", 0, "avg_total_ratings"),
    ).orderBy("avg_rating", "user_group")


@users
def ub03(u: DataFrame) -> DataFrame:
    """Rating tendencies and their share of all users."""
    grouped = u.groupBy("rating_tendency").agg(count("user_count"))
    return with_share(grouped, "user_count", "pct").withColumn(
        "pct", round_to(F.col("pct"), 1)
    ).orderBy(F.desc("user_count"), "rating_tendency")


@users
def ub04(u: DataFrame, k: int = 10) -> DataFrame:
    """Users with the most ratings."""
    return largest(u, "total_ratings", USER, k).select(
        "user_id", "total_ratings", "avg_rating", "viewing_diversity", "user_tier",
        "rating_tendency", "most_watched_tags",
    )


@users
def ub05(u: DataFrame, diversity: str = "Explorer") -> DataFrame:
    """Completion and drop rates of the widest viewers."""
    return u.filter(F.col("viewing_diversity") == diversity).groupBy("viewing_diversity").agg(
        count("user_count"),
        mean("user_completion_rate", 3, "avg_completion_rate"),
        mean("user_drop_rate", 3, "avg_drop_rate"),
        mean("avg_rating", 3, "avg_rating"),
    )


@users
def ub06(u: DataFrame, k: int = 10) -> DataFrame:
    """What the quickest to drop watch most."""
    grouped = u.filter(F.col("drop_tendency") == "High Dropper").groupBy("most_watched_tags").agg(
        count("user_count")
    )
    return grouped.orderBy(
        F.desc("user_count"), F.asc_nulls_last("most_watched_tags")
    ).limit(k)


@users
def ub07(u: DataFrame) -> DataFrame:
    """Completion, drop and engagement per tier."""
    return u.groupBy("user_tier").agg(
        count("user_count"),
        mean("user_completion_rate", 3, "avg_completion"),
        mean("user_drop_rate", 3, "avg_drop"),
        mean("rating_engagement_ratio", 3, "avg_engagement"),
    ).orderBy(F.desc("user_count"), "user_tier")


@users
def ub08(u: DataFrame, min_rating: float = 9.0) -> DataFrame:
    """Users who rate very high on average."""
    return u.filter(F.col("avg_rating") >= min_rating).agg(
        count("user_count"),
        mean("total_ratings", 1, "avg_total_ratings"),
        mean("user_completion_rate", 3, "avg_completion_rate"),
    )


@users
def ub09(u: DataFrame, tendencies: tuple[str, ...] = ("Generous", "Critical")) -> DataFrame:
    """How much generous and critical users watch."""
    return u.filter(F.col("rating_tendency").isin(*tendencies)).groupBy("rating_tendency").agg(
        count("user_count"),
        mean("unique_items_rated", 1, "avg_unique_items"),
        mean("total_ratings", 1, "avg_total_ratings"),
    )


@users
def ub10(u: DataFrame, k: int = 5) -> DataFrame:
    """Users with the most episodes watched."""
    return largest(u, "total_watched_episodes", USER, k).select(
        "user_id", "total_watched_episodes", "total_ratings", "avg_rating", "user_tier",
        "viewing_diversity",
    )


# --- tags ----------------------------------------------------------------------------------


def _rounded(column: str, alias: str, digits: int = 3) -> Column:
    return round_mean(F.col(column), digits).alias(alias)


@tags
def ga01(t: DataFrame, k: int = 10) -> DataFrame:
    """Tags with the most items."""
    return largest(t, "item_count", TAG, k).select(
        "tag", "item_count", _rounded("avg_community_score", "avg_score"), "total_followers"
    )


@tags
def ga02(t: DataFrame, k: int = 5) -> DataFrame:
    """Tags with the best scores."""
    return largest(t, "avg_community_score", TAG, k).select(
        "tag", _rounded("avg_community_score", "avg_score"), "item_count", "total_ratings"
    )


@tags
def ga03(t: DataFrame, k: int = 10) -> DataFrame:
    """Healthiest tags."""
    healthy = t.filter(F.col("tag_health_score").isNotNull())
    return largest(healthy, "tag_health_score", TAG, k).select(
        "tag", _rounded("tag_health_score", "health_score"), "item_count",
        _rounded("avg_community_score", "avg_score"), "trend_category",
        _rounded("recent_ratio", "recent_ratio"),
    )


@tags
def ga04(t: DataFrame) -> DataFrame:
    """Growing tags, fastest first."""
    return t.filter(F.col("trend_category") == "Growing").orderBy(
        F.desc("count_growth_rate"), TAG
    ).select(
        "tag", "trend_category", _rounded("count_growth_rate", "growth_rate"), "item_count",
        _rounded("avg_community_score", "avg_score"),
    )


@tags
def ga05(t: DataFrame) -> DataFrame:
    """Declining tags, fastest first."""
    return t.filter(F.col("trend_category") == "Declining").orderBy(
        F.asc("count_growth_rate"), TAG
    ).select(
        "tag", "trend_category", _rounded("count_growth_rate", "growth_rate"),
        _rounded("score_change", "score_change"), "item_count",
    )


@tags
def ga06(t: DataFrame, k: int = 5) -> DataFrame:
    """The tags completed most and the tags dropped most."""
    def best(label: str, rate: str) -> DataFrame:
        return largest(t, rate, TAG, k).select(
            F.lit(label).alias("category"), "tag", _rounded(rate, "rate"), "item_count"
        )

    return best("Highest Completion", "avg_completion_rate").unionByName(
        best("Highest Drop", "avg_drop_rate")
    )


@tags
def ga07(t: DataFrame, k: int = 5) -> DataFrame:
    """Share of popular items in the tags with the most followers."""
    return largest(t, "total_followers", TAG, k).select(
        "tag", "total_followers", _rounded("popular_ratio", "popular_ratio"), "item_count",
        _rounded("avg_community_score", "avg_score"),
    )


@tags
def ga08(t: DataFrame, above: float = 0.50) -> DataFrame:
    """Tags whose items are mostly recent."""
    return t.filter(F.col("recent_ratio") > above).orderBy(F.desc("recent_ratio"), TAG).select(
        "tag", _rounded("recent_ratio", "recent_ratio"), "item_count", "trend_category",
        _rounded("avg_community_score", "avg_score"),
    )


# --- trends --------------------------------------------------------------------------------


@content
def tr01(c: DataFrame, first_year: int = 2000) -> DataFrame:
    """Items per year."""
    return c.filter(F.col("start_year") >= first_year).groupBy("start_year").agg(
        count("item_count")
    ).orderBy("start_year")


@content
def tr02(c: DataFrame, first_year: int = 2000, kind: str = "ONA") -> DataFrame:
    """Web releases per year."""
    return c.filter((F.col("type") == kind) & (F.col("start_year") >= first_year)).groupBy(
        "start_year"
    ).agg(count("web_count")).orderBy("start_year")


@content
def tr03(c: DataFrame, year: int = 2015) -> DataFrame:
    """Scores before and from a year on."""
    period = F.when(F.col("start_year") >= year, f"{year}+").otherwise(f"Before {year}")
    return (
        c.filter(F.col("start_year").isNotNull() & F.col("community_score").isNotNull())
        .groupBy(period.alias("period"))
        .agg(count("item_count"), mean("community_score", 3, "avg_score"))
        .orderBy("period")
    )


@content
def tr04(c: DataFrame) -> DataFrame:
    """Scores per season."""
    return c.filter(F.col("season").isNotNull()).groupBy("season").agg(
        count("item_count"), mean("community_score", 3, "avg_score")
    ).orderBy(F.desc_nulls_last("avg_score"), "season")


@content
def tr05(c: DataFrame, first_year: int = 2000) -> DataFrame:
    """Drop and completion rates per year."""
    return (
        c.filter((F.col("start_year") >= first_year) & F.col("drop_rate").isNotNull())
        .groupBy("start_year")
        .agg(
            count("item_count"),
            mean("drop_rate", 4, "avg_drop_rate"),
            mean("completion_rate", 4, "avg_completion_rate"),
        )
        .orderBy("start_year")
    )


# --- comparisons ---------------------------------------------------------------------------


@content
def cm01(c: DataFrame, k: int = 10, min_items: int = 20) -> DataFrame:
    """Best makers among those with enough items."""
    grouped = (
        c.filter((F.col("makers") != "Unknown") & F.col("community_score").isNotNull())
        .groupBy("makers")
        .agg(
            count("item_count"),
            mean("community_score", 3, "avg_score"),
            mean("completion_rate", 3, "avg_completion"),
        )
        .filter(F.col("item_count") >= min_items)
    )
    return largest(grouped, "avg_score", "makers", k)


@tags
def cm02(t: DataFrame, pair: tuple[str, ...] = ("Action", "Romance")) -> DataFrame:
    """Two tags side by side."""
    return t.filter(F.col("tag").isin(*pair)).select(
        "tag", _rounded("avg_community_score", "avg_score"),
        _rounded("avg_completion_rate", "completion_rate"), "total_followers", "item_count",
    )


@users
def cm03(u: DataFrame) -> DataFrame:
    """Rating tendency by activity tier."""
    return u.groupBy("user_tier", "rating_tendency").agg(
        count("user_count"),
        mean("avg_rating", 3, "avg_avg_rating"),
        mean("unique_items_rated", 1, "avg_item_count"),
        mean("user_completion_rate", 4, "avg_completion_rate"),
    ).orderBy("user_tier", "rating_tendency")


def decade(year: Column) -> Column:
    return F.when(year.between(2000, 2009), "2000s").when(year.between(2010, 2019), "2010s")


@content
def cm04(c: DataFrame) -> DataFrame:
    """The 2000s against the 2010s."""
    return (
        c.filter(F.col("start_year").between(2000, 2019))
        .groupBy(decade(F.col("start_year")).alias("decade"))
        .agg(
            count("item_count"),
            mean("drop_rate", 4, "avg_drop_rate"),
            mean("completion_rate", 4, "avg_completion_rate"),
            mean("community_score", 3, "avg_score"),
        )
        .orderBy("decade")
    )


@content
def cm05(c: DataFrame,
         sources: tuple[str, ...] = ("Manga", "Light novel", "Original")) -> DataFrame:
    """Three kinds of source material."""
    return (
        c.filter(F.col("source_material").isin(*sources))
        .groupBy("source_material")
        .agg(
            count("item_count"),
            mean("community_score", 3, "avg_score"),
            mean("completion_rate", 3, "avg_completion"),
            mean("followers", 0, "avg_followers"),
        )
        .orderBy(F.desc_nulls_last("avg_score"), "source_material")
    )


# fixed values: first episode count of each band, and its label
EPISODE_BANDS = [
    (53, "52+ eps (very long)"),
    (27, "27-52 eps (long)"),
    (13, "13-26 eps (2 cour)"),
    (2, "2-12 eps (1 cour)"),
    (1, "1 ep (Movie/Special)"),
]


@content
def cm06(c: DataFrame) -> DataFrame:
    """Scores and completion by length; no band for zero episodes."""
    band = ladder(F.col("episodes"), EPISODE_BANDS, None)
    return (
        c.filter(F.col("episodes").isNotNull() & F.col("community_score").isNotNull())
        .groupBy(band.alias("episode_range"))
        .agg(
            count("item_count"),
            mean("community_score", 3, "avg_score"),
            mean("completion_rate", 3, "avg_completion"),
        )
        .orderBy(F.desc_nulls_last("avg_score"), F.asc_nulls_last("episode_range"))
    )


@content
def cm07(c: DataFrame) -> DataFrame:
    """Tag counts of the most followed items and of all items, from one scan.

    The sentinel counts as a tag in the first segment and not in the second.
    """
    segments = F.array_compact(F.array(
        F.when(F.col("followers_tier") == "Top 1%", "Top 1%"),
        F.when(known(F.col("tags")), "All"),
    ))
    return (
        c.select(F.explode(pieces(F.col("tags"))).alias("tag"), segments.alias("segments"))
        .select("tag", F.explode("segments").alias("segment"))
        .groupBy("tag", "segment")
        .agg(count("tag_count"))
        .orderBy("tag", "segment")
    )
