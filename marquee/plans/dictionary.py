"""What every mart column means, which type it has and which values it may hold."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.warehouse import Marts


@dataclass(frozen=True)
class Entry:
    type: str
    meaning: str
    values: tuple[str, ...] = ()


_SHARE_HIGH = Entry("double", "share of ratings of 8 or more")
_SHARE_LOW = Entry("double", "share of ratings of 4 or less")

CONTENT = {
    "item_id": Entry("bigint", "identifier of the item"),
    "name": Entry("string", "title"),
    "type": Entry("string", "format",
                  ("TV", "OVA", "Movie", "Special", "ONA", "Music", "Unknown")),
    "tags": Entry("string", "comma list of tags"),
    "source_material": Entry("string", "kind of work it is adapted from"),
    "source_category": Entry("string", "adapted, original or other",
                             ("IP-based", "Original", "Other-IP")),
    "makers": Entry("string", "comma list of makers"),
    "start_year": Entry("int", "first year of release"),
    "season": Entry("string", "season of release", ("Winter", "Spring", "Summer", "Fall")),
    "episodes": Entry("int", "number of episodes"),
    "is_digital_native": Entry("boolean", "released on the web first"),
    "community_score": Entry("double", "mean score of the community, 1 to 10"),
    "avg_rating": Entry("double", "mean rating of completed viewings"),
    "median_rating": Entry("double", "median rating"),
    "stddev_rating": Entry("double", "sample deviation of the ratings"),
    "high_rating_ratio": _SHARE_HIGH,
    "low_rating_ratio": _SHARE_LOW,
    "followers": Entry("int", "users who keep the item in a list"),
    "followers_tier": Entry("string", "tier by percent rank of followers",
                            ("Top 1%", "Top 5%", "Top 10%", "Upper Half", "Lower Half")),
    "favorites": Entry("int", "users who marked the item as favorite"),
    "rating_count": Entry("bigint", "number of ratings"),
    "completion_rate": Entry("double", "share of list entries completed"),
    "drop_rate": Entry("double", "share of list entries dropped"),
    "plan_rate": Entry("double", "share of list entries planned"),
    "completed_users": Entry("bigint", "list entries completed"),
    "dropped_users": Entry("bigint", "list entries dropped"),
    "watching_users": Entry("bigint", "list entries being watched"),
    "has_text": Entry("boolean", "has a usable text; NULL if the text file lacks the item"),
    "text_words": Entry("bigint", "words of the text"),
    "has_ratings": Entry("boolean", "has been rated"),
    "score_rank": Entry("bigint", "rank by community score, 1 is best"),
    "popularity_rank": Entry("bigint", "rank by followers"),
    "completion_rank": Entry("bigint", "rank by completion rate"),
    "engagement_rank": Entry("bigint", "rank by number of ratings"),
    "performance_score": Entry("double", "weighted score of quality, completion, reach and drops"),
}

USERS = {
    "user_id": Entry("bigint", "identifier of the user"),
    "user_tier": Entry("string", "tier by percent rank of ratings given",
                       ("Power", "Active", "Regular", "Casual")),
    "total_ratings": Entry("bigint", "ratings given"),
    "unique_items_rated": Entry("bigint", "distinct items rated"),
    "total_list_entries": Entry("bigint", "list entries"),
    "total_watched_episodes": Entry("bigint", "episodes watched"),
    "avg_rating": Entry("double", "mean rating given"),
    "stddev_rating": Entry("double", "sample deviation of the ratings given"),
    "median_rating": Entry("double", "median rating given"),
    "high_rating_ratio": _SHARE_HIGH,
    "low_rating_ratio": _SHARE_LOW,
    "completed_count": Entry("bigint", "items completed"),
    "watching_count": Entry("bigint", "items being watched"),
    "dropped_count": Entry("bigint", "items dropped"),
    "plan_to_watch_count": Entry("bigint", "items planned"),
    "user_completion_rate": Entry("double", "share of the user's entries completed"),
    "user_drop_rate": Entry("double", "share of the user's entries dropped"),
    "most_watched_tags": Entry("string", "tag combination rated most often"),
    "rating_tendency": Entry("string", "class by mean rating",
                             ("Generous", "Moderate", "Critical", "Very Critical")),
    "viewing_diversity": Entry("string", "class by distinct items",
                               ("Explorer", "Regular Viewer", "Selective", "Newcomer")),
    "drop_tendency": Entry("string", "class by drop rate",
                           ("High Dropper", "Moderate Dropper", "Committed Viewer")),
    "rating_engagement_ratio": Entry("double", "ratings per list entry"),
}

TAGS = {
    "tag": Entry("string", "one tag"),
    "item_count": Entry("bigint", "distinct items with the tag"),
    "avg_community_score": Entry("double", "mean community score"),
    "avg_user_rating": Entry("double", "mean of the items' mean ratings"),
    "total_followers": Entry("bigint", "sum of followers"),
    "avg_followers": Entry("double", "mean followers"),
    "avg_completion_rate": Entry("double", "mean completion rate"),
    "avg_drop_rate": Entry("double", "mean drop rate"),
    "total_ratings": Entry("bigint", "sum of ratings"),
    "recent_ratio": Entry("double", "share of listings from 2015 on"),
    "popular_ratio": Entry("double", "share of listings in the top tenth by followers"),
    "recent_avg_count": Entry("double", "mean yearly items 2015 to 2019"),
    "prev_avg_count": Entry("double", "mean yearly items 2010 to 2014"),
    "count_growth_rate": Entry("double", "growth between the two"),
    "score_change": Entry("double", "change of the mean yearly score"),
    "trend_category": Entry("string", "class by growth", ("Growing", "Declining", "Stable")),
    "tag_health_score": Entry("double", "weighted score of recency, quality, reach, completion"),
}

TABLES = {"content": CONTENT, "users": USERS, "tags": TAGS}


def described(df: DataFrame, entries: dict[str, Entry]) -> DataFrame:
    """The table with meaning and allowed values as column metadata."""
    for name, entry in entries.items():
        note = {"comment": entry.meaning}
        if entry.values:
            note["values"] = list(entry.values)
        df = df.withMetadata(name, note)
    return df


def measured(df: DataFrame, table: str, entries: dict[str, Entry]) -> DataFrame:
    """The dictionary of one table with what its rows hold: NULLs and values not allowed."""
    kinds = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in entries],
        *[F.count_if(~F.col(n).isin(list(e.values))).alias(f"odd_{n}")
          for n, e in entries.items() if e.values],
    )
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(name).alias("column_name"),
            F.lit(kinds[name]).alias("column_type"),
            F.lit(kinds[name] == entry.type).alias("as_declared"),
            F.lit(entry.meaning).alias("meaning"),
            F.lit(", ".join(entry.values)).alias("allowed"),
            F.col("_rows").alias("row_count"),
            F.col(f"null_{name}").alias("null_count"),
            (F.col(f"odd_{name}") if entry.values else F.lit(0).cast("long"))
            .alias("unlisted_count"),
        )
        for name, entry in entries.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def dictionary(marts: Marts) -> DataFrame:
    """All 74 columns of the three marts."""
    return reduce(
        DataFrame.unionByName,
        [measured(getattr(marts, table), table, entries) for table, entries in TABLES.items()],
    )
