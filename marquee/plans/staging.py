"""Raw sources to typed rows under our own names.  All of it is lazy projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import (
    UNKNOWN,
    has_text,
    season_of,
    try_double,
    try_int,
    words_by_space,
    year_of,
)

# fixed values: which source materials count as adapted from a published work
IP_SOURCES = ["Manga", "Light novel", "Visual novel", "Novel", "Web manga"]
DIGITAL_TYPES = ["ONA"]

# fixed values: list status codes; 5 is not assigned
STATUS_LABELS = {1: "Watching", 2: "Completed", 3: "On Hold", 4: "Dropped", 6: "Plan to Watch"}

# our column -> raw column
_TEXT = {
    "name": "Name", "english_name": "English name", "japanese_name": "Japanese name",
    "type": "Type", "source_material": "Source", "makers": "Studios", "tags": "Genres",
    "age_rating": "Rating", "duration": "Duration", "aired": "Aired", "premiered": "Premiered",
}
_WHOLE = {
    "episodes": "Episodes", "listed_rank": "Popularity", "followers": "Members",
    "favorites": "Favorites", "watching_count": "Watching", "completed_count": "Completed",
    "on_hold_count": "On-Hold", "dropped_count": "Dropped",
    "plan_to_watch_count": "Plan to Watch",
}
_FRACTIONAL = {"score": "Score", "ranked": "Ranked"} | {
    f"score_{level}_count": f"Score-{level}" for level in range(10, 0, -1)
}


def staged_items(raw: DataFrame) -> DataFrame:
    source, kind = F.col("Source"), F.col("Type")
    return raw.select(
        F.col("MAL_ID").alias("item_id"),
        *[F.col(f"`{column}`").alias(name) for name, column in _TEXT.items()],
        *[try_int(F.col(f"`{column}`")).alias(name) for name, column in _WHOLE.items()],
        *[try_double(F.col(f"`{column}`")).alias(name) for name, column in _FRACTIONAL.items()],
        year_of(F.col("Aired")).alias("start_year"),
        season_of(F.col("Premiered")).alias("season"),
        F.when(source == UNKNOWN, None)
        .when(source.isin(IP_SOURCES), "IP-based")
        .when(source == "Original", "Original")
        .otherwise("Other-IP")
        .alias("source_category"),
        F.coalesce(kind.isin(DIGITAL_TYPES), F.lit(False)).alias("is_digital_native"),
    )


def staged_ratings(raw: DataFrame) -> DataFrame:
    rating = F.col("rating")
    return raw.filter(rating.between(1, 10)).select(
        "user_id", F.col("anime_id").alias("item_id"), "rating"
    )


def staged_list_entries(raw: DataFrame) -> DataFrame:
    code = F.col("watching_status")
    label = F
    for number, text in STATUS_LABELS.items():
        label = label.when(code == number, text)
    return raw.select(
        "user_id",
        F.col("anime_id").alias("item_id"),
        "rating",
        code.alias("status_code"),
        label.otherwise(UNKNOWN).alias("status"),
        "watched_episodes",
    )


def staged_item_text(raw: DataFrame) -> DataFrame:
    text = F.col("sypnopsis")
    return raw.select(
        F.col("MAL_ID").alias("item_id"),
        F.col("Name").alias("name"),
        try_double(F.col("Score")).alias("score"),
        F.col("Genres").alias("tags"),
        text.alias("text"),
        has_text(text).alias("has_text"),
        F.length(text).cast("long").alias("text_length"),
        words_by_space(text).alias("text_words"),
    )
