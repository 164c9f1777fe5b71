"""Fact aggregates shared by the item and the user tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import ratio

RATINGS = range(1, 11)
HIGH_RATING = 8
LOW_RATING = 4

# label -> column suffix; fixed values of the list status
STATUSES = {
    "Completed": "completed",
    "Watching": "watching",
    "Dropped": "dropped",
    "On Hold": "on_hold",
    "Plan to Watch": "plan_to_watch",
}


def rating_stats(ratings: DataFrame, key: str) -> DataFrame:
    """Count, mean, exact median, sample deviation, extremes and high/low shares per key.

    Ratings are whole numbers 1..10, so ten counters per key hold the whole distribution: one
    hash aggregate, combined before the shuffle, and no list of values for a busy key.
    """
    return rating_measures(rating_counters(ratings, key), key)


def rating_counters(ratings: DataFrame, key: str) -> DataFrame:
    """(key, _c1 .. _c10): ratings of each value.  Counters of two slices add up."""
    return ratings.groupBy(key).agg(
        *[F.count_if(F.col("rating") == r).alias(f"_c{r}") for r in RATINGS]
    )


def rating_measures(counters: DataFrame, key: str) -> DataFrame:
    """The measures of `rating_stats` from counters."""
    count = {r: F.col(f"_c{r}") for r in RATINGS}
    total = _add(count.values())
    mean = _add(count[r] * r for r in RATINGS).cast("double") / F.col("rating_count")
    spread = _add(count[r] * (F.lit(float(r)) - F.col("avg_rating")) ** 2 for r in RATINGS)
    n = F.col("rating_count")
    return (
        counters.withColumn("rating_count", total)
        .withColumn("avg_rating", mean)
        .select(
            key,
            "rating_count",
            "avg_rating",
            ((_at(count, F.floor((n - 1) / 2)) + _at(count, F.ceil((n - 1) / 2))) / 2.0)
            .alias("median_rating"),
            F.when(n > 1, F.sqrt(spread / (n - 1))).alias("stddev_rating"),
            _first(count, RATINGS).alias("min_rating"),
            _first(count, reversed(RATINGS)).alias("max_rating"),
            ratio(_add(count[r] for r in RATINGS if r >= HIGH_RATING), n)
            .alias("high_rating_ratio"),
            ratio(_add(count[r] for r in RATINGS if r <= LOW_RATING), n)
            .alias("low_rating_ratio"),
        )
    )


def _add(columns) -> Column:
    columns = list(columns)
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _first(count: dict[int, Column], order) -> Column:
    return F.coalesce(*[F.when(count[r] > 0, r) for r in order])


def _at(count: dict[int, Column], index: Column) -> Column:
    """Rating at a 0-based place of the sorted ratings."""
    out, upto = None, None
    for r in RATINGS:
        upto = count[r] if upto is None else upto + count[r]
        out = (F if out is None else out).when(upto > index, r)
    return out


def status_profile(entries: DataFrame, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Entries per status and their shares, per key."""
    return status_shares(status_counters(entries, key, extra))


def status_counters(entries: DataFrame, key: str,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Entries and entries per status, per key.  Counters of two slices add up."""
    return entries.groupBy(key).agg(
        F.count("*").alias("entries"),
        *[F.count_if(F.col("status") == label).alias(name) for label, name in STATUSES.items()],
        *[c.alias(name) for name, c in (extra or {}).items()],
    )


def status_shares(counters: DataFrame) -> DataFrame:
    return counters.withColumns({
        f"{name}_share": ratio(F.col(name), F.col("entries"))
        for name in ("completed", "dropped", "plan_to_watch")
    })


def added_up(slices: Sequence[DataFrame], key: str) -> DataFrame:
    """Counters of several slices as one row per key; a NULL key is a key."""
    together = reduce(DataFrame.unionByName, slices)
    return together.groupBy(key).agg(*[
        F.sum(c).alias(c) for c in together.columns if c != key
    ])


def distinct_per_key(df: DataFrame, key: str, of: str, into: str) -> DataFrame:
    """count(distinct of) per key.  Pairs are spread over (key, of), so a busy key is split."""
    pairs = df.select(key, of).distinct()
    return pairs.groupBy(key).agg(F.count(of).alias(into))


def favourite(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; equal counts go to the value that sorts first."""
    counted = pairs.groupBy(key, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc(value))
    return (
        counted.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .select(key, value)
    )
