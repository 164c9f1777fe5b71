"""The marts under the table and column names that existing queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marquee.plans.dictionary import TABLES, described
from marquee.plans.warehouse import Marts
from marquee.sources.writers import to_version

# fixed values: published table name, and the published names of columns that we call otherwise
PUBLISHED: dict[str, tuple[str, dict[str, str]]] = {
    "content": ("mart_content_performance", {
        "item_id": "anime_id",
        "tags": "genres",
        "makers": "studios",
        "community_score": "mal_score",
        "followers": "members",
        "followers_tier": "members_tier",
        "has_text": "has_synopsis",
        "text_words": "synopsis_word_count",
    }),
    "users": ("mart_user_segments", {
        "unique_items_rated": "unique_anime_rated",
        "most_watched_tags": "most_watched_genres",
    }),
    "tags": ("mart_genre_trends", {
        "tag": "genre",
        "item_count": "anime_count",
        "avg_community_score": "avg_mal_score",
        "total_followers": "total_members",
        "avg_followers": "avg_members",
        "tag_health_score": "genre_health_score",
    }),
}


def published(marts: Marts, table: str) -> DataFrame:
    return described(getattr(marts, table), TABLES[table]).withColumnsRenamed(
        PUBLISHED[table][1]
    )


def publish(marts: Marts, database: str = "main_marts") -> list[str]:
    """Replace the published tables, each in one step; returns their names."""
    names = []
    for table, (name, _) in PUBLISHED.items():
        names.append(f"{database}.{name}")
        to_version(published(marts, table), names[-1])
    return names
