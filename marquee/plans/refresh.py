"""Item tables from kept counters: a refresh reads the new slice of the facts, never the old one.

The state of an item is how often it got each rating and each status.  Means, exact medians, deviations,
extremes, shares and rates all follow from that, and the states of two slices add up, so the state
kept after a load and the state of the rows that came since make the state of everything.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.stats import RATINGS, added_up, rating_counters, status_counters
from marquee.plans.models import Keep, item_stats_of
from marquee.sources.writers import unkept


class ItemState(NamedTuple):
    """One row per item each: counters of ratings, counters of statuses."""

    ratings: DataFrame
    statuses: DataFrame


def state_of(ratings: DataFrame, entries: DataFrame) -> ItemState:
    return ItemState(rating_counters(ratings, "item_id"), status_counters(entries, "item_id"))


def refreshed(old: ItemState, ratings: DataFrame, entries: DataFrame, *,
              keep: Keep = unkept) -> ItemState:
    """The state after new facts; ``keep`` writes it for the next refresh."""
    new = state_of(ratings, entries)
    return ItemState(*[
        keep(name, added_up([before, after], "item_id"))
        for name, before, after in zip(("rating_counters", "status_counters"), old, new, strict=True)
    ])


def item_stats_from(items: DataFrame, state: ItemState) -> DataFrame:
    """The item table as `models.item_stats` makes it from all facts."""
    return item_stats_of(items, state.ratings, state.statuses)


def activity_from(state: ItemState) -> DataFrame:
    """(item_id, rating_count, avg_rating)."""
    count = sum((F.col(f"_c{r}") for r in RATINGS), F.lit(0))
    points = sum((F.col(f"_c{r}") * r for r in RATINGS), F.lit(0))
    return state.ratings.select("item_id", count.alias("rating_count"), (points / count).alias("avg_rating"))
