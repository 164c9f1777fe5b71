"""Thirteen named metrics, each an aggregate that works over any grouping of its table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import ratio, unit_score
from marquee.operators.stats import HIGH_RATING, LOW_RATING
from marquee.plans.models import POPULAR_TIERS, PREVIOUS_YEARS, RECENT_YEARS


@dataclass(frozen=True)
class Metric:
    kind: str
    table: str
    meaning: str
    expression: Callable[[], Column]


def _status_share(label: str) -> Callable[[], Column]:
    return lambda: ratio(F.count_if(F.col("status") == label), F.count("*"))


def _health() -> Column:
    def share(condition: Column) -> Column:
        return ratio(F.count_if(condition), F.count("*"))

    return (
        0.3 * share(F.col("start_year") >= RECENT_YEARS[0])
        + 0.3 * unit_score(F.avg("community_score"))
        + 0.2 * share(F.col("followers_tier").isin(POPULAR_TIERS))
        + 0.2 * F.avg("completion_rate")
    )


# tables: content = one row per item; listings = one row per item and tag; ratings and entries =
# the staged facts; users = one row per user; tag_years = one row per tag and year
METRICS: dict[str, Metric] = {
    "avg_score": Metric(
        "average", "content", "mean community score",
        lambda: F.avg("community_score")),
    "completion_rate": Metric(
        "ratio", "entries", "share of list entries completed", _status_share("Completed")),
    "drop_rate": Metric(
        "ratio", "entries", "share of list entries dropped", _status_share("Dropped")),
    "performance_score": Metric(
        "composite", "content", "mean composite score", lambda: F.avg("performance_score")),
    "high_rating_ratio": Metric(
        "ratio", "ratings", "share of ratings of 8 or more",
        lambda: ratio(F.count_if(F.col("rating") >= HIGH_RATING), F.count("*"))),
    "low_rating_ratio": Metric(
        "ratio", "ratings", "share of ratings of 4 or less",
        lambda: ratio(F.count_if(F.col("rating") <= LOW_RATING), F.count("*"))),
    "total_ratings": Metric("count", "ratings", "number of ratings", lambda: F.count("*")),
    "user_avg_rating": Metric("average", "ratings", "mean rating", lambda: F.avg("rating")),
    "user_completion_rate": Metric(
        "ratio", "entries", "share of a user's entries completed", _status_share("Completed")),
    "rating_engagement_ratio": Metric(
        "ratio", "users", "ratings per list entry",
        lambda: ratio(F.sum("total_ratings"), F.sum("total_list_entries"))),
    "tag_item_count": Metric(
        "count", "listings", "distinct items with the tag",
        lambda: F.count_distinct("item_id")),
    "tag_health_score": Metric("composite", "listings", "health of the tag", _health),
    "count_growth_rate": Metric(
        "growth", "tag_years", "growth of the mean yearly item count between two windows",
        lambda: _growth("item_count")),
}


def _growth(column: str) -> Column:
    def mean_in(window: tuple[int, int]) -> Column:
        return F.avg(F.when(F.col("start_year").between(*window), F.col(column)))

    recent, previous = mean_in(RECENT_YEARS), mean_in(PREVIOUS_YEARS)
    return F.when(previous > 0, (recent - previous) / previous)


def metric(
    df: DataFrame, name: str, by: Sequence[str] = (), where: Column | None = None
) -> DataFrame:
    """The metric per group of ``by`` over the rows that ``where`` keeps."""
    if name not in METRICS:
        raise KeyError(f"no metric {name!r}; known: {sorted(METRICS)}")
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*by).agg(METRICS[name].expression().alias(name))



