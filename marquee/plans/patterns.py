"""The ten query patterns, as functions of the content and user tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import known
from marquee.operators.distribution import VALUES_PER_RANGE, add_ranks
from marquee.operators.explode import explode_list
from marquee.plans.models import POPULAR_TIERS
from marquee.plans.questions import ITEM, count, decade, largest, mean, ub03


def tag_explode(c: DataFrame) -> DataFrame:
    """Items and mean score per listed tag."""
    return explode_list(c, "tags", "tag").groupBy("tag").agg(
        count("item_count"), F.avg("community_score").alias("avg_score")
    ).orderBy(F.desc("item_count"), "tag")


def tier_filter(c: DataFrame, k: int = 20) -> DataFrame:
    """Items of the top tenth, by followers."""
    popular = c.filter(F.col("followers_tier").isin(POPULAR_TIERS))
    return largest(popular, "followers", ITEM, k).select(
        "name", "followers", "community_score", "completion_rate"
    )


def segment_means(u: DataFrame) -> DataFrame:
    return u.groupBy("user_tier").agg(
        count("user_count"),
        mean("avg_rating", 3, "avg_avg_rating"),
        mean("user_completion_rate", 4, "avg_completion_rate"),
    ).orderBy("user_tier")


def segment_share(u: DataFrame) -> DataFrame:
    return ub03(u)


def year_range(c: DataFrame, first: int = 2000, last: int = 2020) -> DataFrame:
    return c.filter(F.col("start_year").between(first, last)).groupBy("start_year").agg(
        count("item_count"),
        mean("community_score", 3, "avg_score"),
        mean("completion_rate", 4, "avg_completion_rate"),
    ).orderBy("start_year")


def decade_comparison(c: DataFrame) -> DataFrame:
    period = decade(F.col("start_year"))
    return c.filter(period.isNotNull()).groupBy(period.alias("decade")).agg(
        count("item_count"),
        mean("community_score", 3, "avg_score"),
        mean("completion_rate", 4, "avg_completion_rate"),
        mean("drop_rate", 4, "avg_drop_rate"),
    ).orderBy("decade")


def segment_pivot(
    u: DataFrame, labels: tuple[str, ...] = ("Generous", "Moderate", "Critical")
) -> DataFrame:
    """Users per tier, one column per rating tendency."""
    return u.groupBy("user_tier").agg(*[
        F.count_if(F.col("rating_tendency") == label).alias(f"{label.lower()}_count")
        for label in labels
    ])


def top_share(
    c: DataFrame, least: float = 0.9, *, per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Items at or above a percent rank of the composite score."""
    scored = c.filter(F.col("performance_score").isNotNull()).select(
        ITEM, "name", "performance_score"
    )
    ranked = add_ranks(
        scored, {"pct_rank": ("percent_rank", "performance_score")},
        per_range=per_range,
    )
    return (
        ranked.filter(F.col("pct_rank") >= least)
        .orderBy(F.desc("performance_score"), ITEM)
        .select("name", "performance_score", "pct_rank")
    )


def single_maker(c: DataFrame, k: int = 10, min_items: int = 5) -> DataFrame:
    """Mean scores of makers, counting only items made by one maker alone."""
    alone = c.filter(known(F.col("makers")) & ~F.col("makers").contains(","))
    grouped = alone.groupBy(F.trim("makers").alias("maker")).agg(
        count("item_count"),
        mean("community_score", 3, "avg_score"),
        mean("completion_rate", 4, "avg_completion_rate"),
    ).filter(F.col("item_count") >= min_items)
    return largest(grouped, "avg_score", "maker", k)


def table_sample(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """k rows as good as any: those whose key hashes lowest, the same however the table is split.

    Every task hands on its k lowest rows only.  Equal digests are told apart by the key.
    """
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(k)
