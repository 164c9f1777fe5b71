"""name -> DuckDB statement, for every query that SQL can check."""

from __future__ import annotations

from oracle.checks import CHECKS, COMPARISONS, METRICS
from oracle.profiles import PROFILES
from oracle.questions import PATTERNS, QUESTIONS
from oracle.tables import sql

_RATES = "avg_rating median_rating stddev_rating high_rating_ratio low_rating_ratio"

TABLES: dict[str, tuple[str, str]] = {
    "stg_items": ("select * from stg_items", "score ranked " + " ".join(
        f"score_{n}_count" for n in range(1, 11))),
    "stg_ratings": ("select * from stg_ratings", ""),
    "stg_list_entries": ("select * from stg_list_entries", ""),
    "stg_item_text": ("select * from stg_item_text", "score"),
    "item_stats": ("select * from item_stats",
                   f"community_score {_RATES} completion_rate drop_rate plan_rate"),
    "item_stats_refreshed": ("select * from item_stats",
                             f"community_score {_RATES} completion_rate drop_rate plan_rate"),
    "item_stats_by_key": ("select * from item_stats",
                          f"community_score {_RATES} completion_rate drop_rate plan_rate"),
    "user_profiles": ("select * from user_profiles",
                      f"{_RATES} user_completion_rate user_drop_rate"),
    "tag_metrics": ("select * from tag_metrics",
                    "avg_community_score avg_user_rating avg_followers avg_completion_rate "
                    "avg_drop_rate avg_rating_count recent_ratio popular_ratio"),
    "content_performance": ("select * from content",
                            f"community_score {_RATES} completion_rate drop_rate plan_rate "
                            "performance_score"),
    "user_segments": ("select * from users",
                      f"{_RATES} user_completion_rate user_drop_rate rating_engagement_ratio"),
    "tag_trends": ("select * from tags",
                   "avg_community_score avg_user_rating avg_followers avg_completion_rate "
                   "avg_drop_rate recent_ratio popular_ratio recent_avg_count prev_avg_count "
                   "count_growth_rate score_change tag_health_score"),
}


def all_sql() -> dict[str, str]:
    files = {f"csv_{name.removeprefix('stg_')}": select for name, select in TABLES.items()
             if name.startswith("stg_")}
    # an empty text in a CSV file is no text
    files["csv_item_text"] = ("""select * replace (nullif(text, '') as text,
        nullif(text_length, 0) as text_length) from stg_item_text""", "score")
    parts = TABLES | files | QUESTIONS | PATTERNS | PROFILES | CHECKS | METRICS | COMPARISONS
    return {name: sql(select, doubles=doubles) for name, (select, doubles) in parts.items()}
