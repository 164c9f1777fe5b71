"""Profiles of the catalogue and the facts: shares, distributions, concentration, cold start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import (
    UNKNOWN,
    cut,
    equal_width_bin,
    first_listed,
    percent,
    ratio,
)
from marquee.operators.distribution import (
    VALUES_PER_RANGE,
    attach,
    cdf,
    cumulative,
    describe,
    gini,
    histogram,
    lorenz,
    quantiles,
    top_share,
)
from marquee.operators.explode import explode_list, list_length
from marquee.plans.questions import count, with_share
from marquee.plans.staging import STATUS_LABELS

# fixed values: bin edges, right-closed, and labels
SCORE_EDGES = [0, 4, 5, 6, 7, 8, 9, 10]
SCORE_BANDS = ["(0, 4]", "(4, 5]", "(5, 6]", "(6, 7]", "(7, 8]", "(8, 9]", "(9, 10]"]
ACTIVITY_EDGES = [0, 10, 30, 100, 300, 1000, float("inf")]
ACTIVITY_BANDS = ["1-10", "11-30", "31-100", "101-300", "301-1000", "1000+"]

SEASONS = ["Winter", "Spring", "Summer", "Fall"]
TYPES = ["TV", "OVA", "Movie", "ONA", "Special", "Music", UNKNOWN]


def _as_rows(one_row: DataFrame, label: str, names: Sequence[str], value: str) -> DataFrame:
    """The columns of a one-row frame as rows (label, value)."""
    cells = [F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names]
    return one_row.select(F.inline(F.array(*cells)))


# --- shares and counts ---------------------------------------------------------------------


def null_share(df: DataFrame) -> DataFrame:
    """(column_name, null_pct) of every column, in one pass."""
    names = df.columns
    shares = df.agg(*[
        percent(F.count_if(F.col(f"`{n}`").isNull()), F.count("*")).alias(n) for n in names
    ])
    return _as_rows(shares, "column_name", names, "null_pct")


def sentinel_share(df: DataFrame, names: Sequence[str], sentinel: str = UNKNOWN) -> DataFrame:
    """(column_name, sentinel_count, sentinel_pct) of some text columns, in one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{n}`") == sentinel).alias(n) for n in names],
    )
    rows = [F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("sentinel_count"),
                     percent(F.col(f"`{n}`"), F.col("_rows")).alias("sentinel_pct"))
            for n in names]
    return counts.select(F.inline(F.array(*rows)))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Rows that repeat an earlier value; NULL is a value."""
    return df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).agg(
        F.lit(name).alias("column_name"),
        F.sum("n").alias("row_count"),
        F.sum(F.col("n") - 1).alias("duplicate_count"),
        (F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_ratio"),
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return (
        df.filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(count("value_count"))
        .orderBy(F.desc("value_count"), name)
    )


def value_shares(df: DataFrame, name: str) -> DataFrame:
    """Counts per value with the percentage of all rows."""
    grouped = df.groupBy(name).agg(count("value_count"))
    return with_share(grouped, "value_count", "pct").orderBy(name)


def counts_in_order(df: DataFrame, name: str, categories: Sequence[str]) -> DataFrame:
    """Counts of the given categories in the given order, 0 where there is none."""
    found = df.agg(*[F.count_if(F.col(name) == c).alias(c) for c in categories])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("category"),
                     F.col(f"`{c}`").alias("value_count")) for i, c in enumerate(categories)]
    return found.select(F.inline(F.array(*rows)))


def group_stats(items: DataFrame, key: str) -> DataFrame:
    """Scored items per key: how many, their mean score, their mean followers."""
    return items.filter(F.col("score").isNotNull()).groupBy(key).agg(
        F.count("score").alias("item_count"),
        F.avg("score").alias("avg_score"),
        F.avg("followers").alias("avg_followers"),
    )


def primary_maker_stats(items: DataFrame, min_items: int = 1) -> DataFrame:
    """``group_stats`` by the first listed maker."""
    named = items.filter(F.col("makers") != UNKNOWN).withColumn(
        "primary_maker", first_listed(F.col("makers"))
    )
    return group_stats(named, "primary_maker").filter(F.col("item_count") >= min_items)


def score_by_tag(items: DataFrame, min_items: int = 50) -> DataFrame:
    scored = items.filter(F.col("score").isNotNull())
    return explode_list(scored, "tags", "tag", delimiter=", ").groupBy("tag").agg(
        F.avg("score").alias("avg_score"), F.count("score").alias("item_count")
    ).filter(F.col("item_count") >= min_items)


def tag_counts(items: DataFrame) -> DataFrame:
    return value_counts(explode_list(items, "tags", "tag", delimiter=", "), "tag")


def tags_per_item(items: DataFrame) -> DataFrame:
    listed = items.select(list_length(F.col("tags")).alias("tag_count"))
    return describe(listed, "tag_count", [0.25, 0.5, 0.75])


# --- over the years ------------------------------------------------------------------------


def yearly_series(items: DataFrame, first_year: int = 1960) -> DataFrame:
    """Items per year, and the mean score and number of the scored ones."""
    return items.filter(F.col("start_year") >= first_year).groupBy("start_year").agg(
        count("item_count"),
        F.avg("score").alias("avg_score"),
        F.count("score").alias("scored_count"),
    ).orderBy("start_year")


def pivot_year_type(
    items: DataFrame, first_year: int = 2000, types: Sequence[str] = TYPES
) -> DataFrame:
    """One row per year, one column of counts per type, and one for all other types and none."""
    listed = F.coalesce(F.col("type").isin(list(types)), F.lit(False))
    return (
        items.filter(F.col("start_year") >= first_year)
        .groupBy("start_year")
        .agg(*[F.count_if(F.col("type") == t).alias(f"{t.lower()}_count") for t in types],
             F.count_if(~listed).alias("other_count"))
        .orderBy("start_year")
    )


# --- followers and scores ------------------------------------------------------------------


def engagement(items: DataFrame) -> DataFrame:
    """Scored items with their completion and drop rates *among followers*.

    Not the model's rates, which are shares of list entries.
    """
    followers = F.col("followers")
    return items.filter(
        F.col("score").isNotNull() & F.col("completed_count").isNotNull() & (followers > 0)
    ).select(
        "item_id", "score", "followers",
        ratio(F.col("completed_count"), followers).alias("completed_per_follower"),
        ratio(F.col("dropped_count"), followers).alias("dropped_per_follower"),
        F.log10(F.greatest(followers, F.lit(1))).alias("log_followers"),
    )


def correlations(
    df: DataFrame, against: str, names: Sequence[str]
) -> DataFrame:
    """Pearson correlation of one column with each of several, in one pass."""
    row = df.agg(*[
        F.corr(F.col(against).cast("double"), F.col(n).cast("double")).alias(n) for n in names
    ])
    return _as_rows(row, "column_name", names, "correlation")


def binned_rates(items: DataFrame) -> DataFrame:
    band = cut(F.col("score"), SCORE_EDGES, SCORE_BANDS)
    return engagement(items).groupBy(band.alias("score_band")).agg(
        count("item_count"),
        F.avg("completed_per_follower").alias("avg_completion"),
        F.avg("dropped_per_follower").alias("avg_drop"),
    )


def equal_width_histogram(
    df: DataFrame, value: Column, bins: int, weight: Column | None = None
) -> DataFrame:
    """(bin, low, high, row_count) of non-empty bins of equal width between minimum and maximum.

    With a weight also its sum and the density, which integrates to one.
    """
    weight = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    held = df.select(value.cast("double").alias("value"), weight.alias("weight")).filter(
        F.col("value").isNotNull()
    )
    # two scans and no shuffle of rows: limits first, then one partial count per bin and task
    limits = held.agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"),
        F.sum("weight").alias("_total"),
    )
    low, high = F.col("_low"), F.col("_high")
    width = (high - low) / bins
    placed = attach(held, limits).withColumn(
        "bin", equal_width_bin(F.col("value"), low, high, bins)
    )
    return placed.groupBy("bin").agg(
        F.max(low + F.col("bin") * width).alias("low"),
        F.max(low + (F.col("bin") + 1) * width).alias("high"),
        F.count("*").alias("row_count"),
        F.sum("weight").alias("weight"),
        (F.sum("weight") / F.nullif(F.max("_total"), F.lit(0.0))
         / F.max(F.nullif(width, F.lit(0.0))))
        .alias("density"),
    )


def histogram_by(df: DataFrame, value: Column, bins: int, by: str) -> DataFrame:
    """(by, bin, low, high, row_count, density) of non-empty bins, each group between its own limits.

    For a few groups with known labels: their limits go along with every row.  The density of each
    group integrates to one, so that groups of any size compare.
    """
    held = df.select(F.col(by), value.cast("double").alias("value")).dropna()
    limits = held.groupBy(by).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("total")
    ).agg(F.map_from_entries(F.collect_list(F.struct(by, F.struct("low", "high", "total"))))
          .alias("_limits"))
    own = F.element_at("_limits", F.col(by))
    low, width = own["low"], (own["high"] - own["low"]) / bins
    placed = attach(held, limits).withColumn(
        "bin", equal_width_bin(F.col("value"), own["low"], own["high"], bins)
    )
    return placed.groupBy(by, "bin").agg(
        F.max(low + F.col("bin") * width).alias("low"),
        F.max(low + (F.col("bin") + 1) * width).alias("high"),
        F.count("*").alias("row_count"),
        (F.count("*") / F.max(own["total"]) / F.max(F.nullif(width, F.lit(0.0)))).alias("density"),
    )


def with_activity_group(ratings: DataFrame, point: float = 0.99) -> DataFrame:
    """Activity of users, and whether they are at or above a quantile of it."""
    users = activity(ratings, "user_id")
    bound = quantiles(users, "rating_count", [point]).toDF("bound")
    busy = F.col("rating_count") >= F.col("bound")
    return attach(users, bound).withColumn("user_group", F.when(busy, "power").otherwise("rest"))


def log_histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """Equal bins on the decimal logarithm; values below one count as one."""
    held = df.filter(F.col(name).isNotNull())
    return equal_width_histogram(held, F.log10(F.greatest(F.col(name), F.lit(1))), bins)


def box_by_group(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, extremes and count per group."""
    boxes = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0], [by])
    sizes = df.filter(F.col(value).isNotNull()).groupBy(by).agg(count("row_count"))
    return sizes.withColumn("_g", F.struct(by)).drop(by).join(
        boxes.withColumn("_g", F.struct(by)), "_g"
    ).drop("_g")


# --- concentration -------------------------------------------------------------------------


def _largest_fractions(fractions: Sequence[float]) -> dict[str, Column]:
    return {
        f"top {format(p * 100, 'g')}%": F.floor(F.col("total") * F.lit(p)) for p in fractions
    }


def concentration(df: DataFrame, value: str, fractions: Sequence[float] = (0.01, 0.05, 0.10),
                  *, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """Share of the sum held by the largest fractions of the rows.

    The fractions are of all rows; rows without a value are the smallest.
    """
    all_rows = df.select(F.coalesce(F.col(value), F.lit(0)).alias(value))
    counts = cumulative(all_rows, value, weigh=True, per_range=per_range)
    return top_share(counts, _largest_fractions(fractions))


def concentration_top_n(df: DataFrame, value: str,
                        sizes: Sequence[int] = (10, 50, 100, 500)) -> DataFrame:
    counts = cumulative(df, value, weigh=True)
    return top_share(counts, {f"top {k}": F.lit(k) for k in sizes})


def gini_of(df: DataFrame, value: str, *, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    return gini(cumulative(df, value, weigh=True, per_range=per_range))


def lorenz_of(df: DataFrame, value: str, *, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    return lorenz(cumulative(df, value, weigh=True, per_range=per_range))


def cdf_of(df: DataFrame, value: str, *, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    return cdf(cumulative(df, value, per_range=per_range))


# --- ratings and lists ---------------------------------------------------------------------


def activity(ratings: DataFrame, key: str) -> DataFrame:
    """Ratings per user or per item, and their mean."""
    return ratings.groupBy(key).agg(
        count("rating_count"), F.avg("rating").alias("avg_rating")
    )


def rating_overview(ratings: DataFrame) -> DataFrame:
    """Size, users, items, extremes, mean, median and sparsity of the rating matrix.

    Users and items are counted apart: two distinct counts in one aggregate would triple the rows.
    """
    spread = ratings.groupBy("rating").agg(F.count("*").alias("n"))
    totals = spread.agg(
        F.sum("n").alias("rating_count"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        (F.sum(F.col("rating") * F.col("n")) / F.sum("n")).alias("avg_rating"),
    )
    middle = quantiles(ratings, "rating", [0.5]).withColumnRenamed("p50", "median_rating")

    def size(key: str, alias: str) -> DataFrame:
        return ratings.select(key).distinct().agg(F.count(key).alias(alias))

    out = totals
    for one_row in (middle, size("user_id", "user_count"), size("item_id", "item_count")):
        out = attach(out, one_row)
    pairs = F.col("user_count").cast("double") * F.col("item_count")
    return out.withColumn("sparsity", 1 - F.col("rating_count") / F.nullif(pairs, F.lit(0.0)))


def cold_start(ratings: DataFrame, fixed: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Percentage of users and of items with at most t ratings.

    The thresholds are the given ones and the 10% and 20% quantiles of the users' counts; the
    label says which quantiles a threshold is.
    """
    per_user = ratings.groupBy("user_id").agg(count("rating_count"))
    per_item = ratings.groupBy("item_id").agg(count("rating_count"))

    def low_quantiles(counts: DataFrame, prefix: str) -> DataFrame:
        found = quantiles(counts, "rating_count", [0.1, 0.2])
        return found.select(*[F.floor(p).cast("long").alias(f"{prefix}_{p}")
                              for p in ("p10", "p20")])

    marks = attach(low_quantiles(per_user, "user"), low_quantiles(per_item, "item"))
    wanted = F.array_distinct(F.array(
        "user_p10", "user_p20", *[F.lit(t).cast("long") for t in fixed]
    ))

    def cold(counts: DataFrame, alias: str) -> DataFrame:
        spread = histogram(counts, "rating_count")
        return (
            attach(spread, marks)
            .withColumn("threshold", F.explode(wanted))
            .groupBy("threshold")
            .agg(
                (100.0 * F.sum(F.when(F.col("value") <= F.col("threshold"), F.col("n"))
                               .otherwise(0)) / F.sum("n")).alias(alias),
                F.max(F.concat_ws(" ", *[
                    F.when(F.col("threshold") == F.col(mark), mark.replace("_", " "))
                    for mark in ("user_p10", "user_p20", "item_p10", "item_p20")
                ])).alias("label"),
            )
        )

    return cold(per_user, "cold_user_pct").join(
        cold(per_item, "cold_item_pct").drop("label"), "threshold"
    )


def rating_by_activity(ratings: DataFrame) -> DataFrame:
    """Users banded by activity, with the mean and deviation of their mean ratings."""
    band = cut(F.col("rating_count"), ACTIVITY_EDGES, ACTIVITY_BANDS)
    return activity(ratings, "user_id").groupBy(band.alias("activity_band")).agg(
        count("user_count"),
        F.avg("avg_rating").alias("avg_rating"),
        F.stddev("avg_rating").alias("std_rating"),
    )


def power_vs_rest(ratings: DataFrame, point: float = 0.99) -> DataFrame:
    """Users at or above a quantile of activity against the others."""
    compared = with_activity_group(ratings, point).groupBy("user_group").agg(
        count("user_count"),
        F.sum("rating_count").alias("total_ratings"),
        F.avg("avg_rating").alias("avg_rating"),
    )
    return with_share(with_share(compared, "user_count", "user_pct"), "total_ratings",
                      "rating_pct")


def _status_name() -> Column:
    name = F
    for code, label in STATUS_LABELS.items():
        name = name.when(F.col("status_code") == code, label)
    return name


def status_distribution(entries: DataFrame) -> DataFrame:
    """Entries per status code: share, mean rating, share of entries that carry a rating."""
    grouped = entries.groupBy("status_code").agg(
        count("entry_count"),
        F.avg("rating").alias("avg_rating"),
        F.count_if(F.col("rating") > 0).alias("rated_count"),
    )
    return with_share(grouped, "entry_count", "pct").select(
        "status_code",
        _status_name().alias("status_name"),
        "entry_count",
        "avg_rating",
        "rated_count",
        "pct",
        (100.0 * F.col("rated_count") / F.col("entry_count")).alias("rated_pct"),
    ).orderBy(F.asc_nulls_last("status_code"))


def status_of_raters(entries: DataFrame, ratings: DataFrame) -> DataFrame:
    """``status_distribution`` over the entries of users who have rated anything.

    The entries are counted per user and status before the semi-join, so a user with very many of
    them brings one row per status to it.
    """
    per_user = entries.groupBy("user_id", "status_code").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rating") > 0).alias("rated"),
        F.sum(F.when(F.col("rating") > 0, F.col("rating"))).alias("points"),
    )
    raters = ratings.select("user_id").distinct()
    return (
        per_user.join(raters, "user_id", "left_semi")
        .groupBy("status_code")
        .agg(
            F.sum("n").alias("entry_count"),
            ratio(F.sum("points"), F.sum("rated")).alias("avg_rating_when_rated"),
            (100.0 * F.sum("rated") / F.sum("n")).alias("rated_pct"),
        )
        .withColumn("status_name", _status_name())
        .orderBy(F.asc_nulls_last("status_code"))
    )


def tag_diversity(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct tags per user, as the union of bitmaps.

    Tags are numbered, and an item's tags are set bits of few words of 64.  What a user rated is joined
    word by word; `bit_or` unites them before the shuffle, so a busy user sends one row per word and
    task, and no (user, tag) pair is ever made.
    """
    tagged = items.filter(F.col("tags").isNotNull()).select("item_id", "tags")
    listed = explode_list(tagged, "tags", "tag", delimiter=", ", drop_unknown=False).select("item_id", "tag")
    # distinct tags alone are put in order: a list of labels, however many items carry them
    numbers = listed.select("tag").distinct().withColumn(
        "number", F.row_number().over(Window.orderBy("tag")) - 1
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    words = listed.join(numbers, "tag").groupBy(
        "item_id", F.floor(F.col("number") / 64).alias("word")
    ).agg(F.bit_or(bit).alias("bits"))
    united = ratings.select("user_id", "item_id").join(words, "item_id").groupBy("user_id", "word").agg(
        F.bit_or("bits").alias("bits")
    )
    return united.groupBy("user_id").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("tag_count")
    )
