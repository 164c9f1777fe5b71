"""Global order statistics without a single-task sort.

A window with no partition key moves every row to one task.  Here the values are first reduced
to a histogram, the histogram is cut into ranges of about equal numbers of *distinct* values,
running totals are taken inside each range, and the totals of the earlier ranges are added.  A
value held by a third of the rows is one histogram row like any other.

The cut points are values picked by their hash.  Which values those are depends on the data alone,
never on task order, so the ranges stay the same when a lost executor makes Spark compute any part
again, and nothing has to be pinned.  They lie on two levels: `FAN` coarse ranges, and inside a coarse
range, joined by its number, the cut points of that range alone.  So a row never meets more than about
`FAN` cut points at a time, and no task gathers more than `FAN` times `SAMPLES_PER_RANGE` values
(`FAN` squared ranges, at the default size 13 billion distinct values; beyond that ranges grow).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.sources.writers import Keep, unkept

FAN = 512
# cut points are searched by halving; twice as many as wanted can be told apart
HALVINGS = 10
VALUES_PER_RANGE = 50_000
SAMPLES_PER_RANGE = 8


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, n): rows per value, combined before the shuffle; n is 0 for NULL.

    NULL is kept as an empty entry, not filtered away: the filter would be pushed below and work
    out a costly value expression a second time.
    """
    return df.groupBy(*by, F.col(value).alias("value")).agg(F.count(value).alias("n"))


def _totals(df: DataFrame, value: str, by: Sequence[str], **options) -> DataFrame:
    """Running totals with an empty entry for NULL."""
    return running_totals(histogram(df, value, by), by, **options)


def cumulative(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    *,
    weigh: bool = False,
    per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """One row per (by..., value), NULL values left out, in value order:

    ``n`` rows with the value, ``upto`` rows at or below it, ``total`` rows in all; with ``weigh``
    also ``sum_upto`` and ``sum_total`` of the (numeric) values themselves.
    """
    held = df.filter(F.col(value).isNotNull())
    return _totals(held, value, by, weigh=weigh, per_range=per_range)


def _cuts_upto(value: Column) -> Column:
    """How many of the sorted cut points are at or below the value, by halving steps."""
    steps = F.array(*[F.lit(1 << bit) for bit in range(HALVINGS - 1, -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(F.get("_cuts", found + step - 1) <= value, found + step)
        .otherwise(found),
    )
    # never NULL, and declared so: a join on it then brings no check that is pushed to the scan
    return F.when(F.col("_cuts").isNotNull(), F.coalesce(found, F.lit(0))).otherwise(0)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery and not a join."""
    names = one_row.columns
    return df.withColumn("_row", one_row.select(F.struct(*names)).scalar()).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col("_row")[c].alias(c) for c in names]
    )


def running_totals(
    hist: DataFrame,
    by: Sequence[str] = (),
    *,
    weigh: bool = False,
    per_range: int = VALUES_PER_RANGE,
    distinct: DataFrame | None = None,
    largest: int | None = None,
    keep: Keep = unkept,
) -> DataFrame:
    """As ``cumulative``, for a histogram (by..., value, n) that is already made.

    If every n is 1 and the group sizes are known, pass them as ``distinct`` (by..., size).  ``largest``
    is the most distinct values of a group, if known: one level of ranges may then do.  ``keep`` is
    the cut point after the cut points of the ranges, which Spark then broadcasts by their size, and
    after the search for each value's range, whose result is read twice.
    """
    keys = [f"_by{i}" for i, _ in enumerate(by)]
    # a struct is never NULL itself, so groups with a NULL key join like any other
    packed = [F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)]
    hist = hist.select(*packed, "value", "n")
    sums = {"n": F.col("n")}
    if weigh:
        sums["sum"] = F.col("value") * F.col("n")

    def with_group(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        """Add what is known of each row's group; without groups that is a single row."""
        return df.join(facts, keys, how) if keys else attach(df, facts)

    if distinct is None:
        sizes = hist.groupBy(*keys).agg(
            F.count("*").alias("_distinct"),
            *[F.sum(c).alias(f"_{name}_total") for name, c in sums.items()],
        )
    else:
        sizes = distinct.select(
            *packed, F.col("size").alias("_distinct"), F.col("size").alias("_n_total")
        )
    ranges = F.ceil(F.col("_distinct") / F.lit(per_range))
    sizes = sizes.withColumn("_ranges", F.least(ranges, F.lit(FAN * FAN)))

    def cuts_of(rows: DataFrame, at: list[str], wanted: Column, step: Column, seed: int) -> DataFrame:
        """Sorted cut points per ``at``: of ``wanted`` values picked by hash every ``step``-th."""
        picked = F.pmod(F.xxhash64(F.lit(seed), "value"), F.col("_distinct")) < wanted
        sample = rows.filter(picked).groupBy(*at).agg(
            F.sort_array(F.collect_list("value")).alias("_sample"), F.max(step).alias("_step")
        )
        return sample.select(*at, F.filter(
            "_sample", lambda _, i: i % F.col("_step") == 0
        ).alias("_cuts"))

    # the conditions name n, always >= 0: without it they would be pushed below the histogram, and this
    # branch would build one of its own instead of reusing the others' shuffle
    several = (F.col("n") >= 0) & (F.col("_ranges") > 1)
    coarse = F.least("_ranges", F.lit(FAN))
    first = cuts_of(with_group(hist, sizes), keys, F.when(several, coarse * SAMPLES_PER_RANGE),
                    F.lit(SAMPLES_PER_RANGE), 0)
    near = with_group(hist, keep("cuts", first), "left").select(
        *keys, _cuts_upto(F.col("value")).alias("_coarse"), "value", "n"
    )
    if largest is not None and largest <= FAN * per_range:
        fine = F.lit(0)
    else:
        many = (F.col("n") >= 0) & (F.col("_ranges") > FAN)
        second = cuts_of(with_group(near, sizes), [*keys, "_coarse"],
                         F.when(many, F.col("_ranges") * SAMPLES_PER_RANGE), F.lit(SAMPLES_PER_RANGE), 1)
        fine, near = _cuts_upto(F.col("value")), near.join(second, [*keys, "_coarse"], "left")
    placed = keep("ranges", near.select(
        *keys, F.struct("_coarse", fine.alias("_fine")).alias("_range"), "value", "n"
    ))

    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_group_range = placed.groupBy(*keys, "_range").agg(
        *[F.sum(c).alias(f"_{name}") for name, c in sums.items()]
    )
    offsets = with_group(per_group_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}_before")
          for name in sums],
    ), sizes)
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = placed.select(
        *keys, "_range", "value", "n",
        *[F.sum(c).over(inside).alias(f"_{name}_inside") for name, c in sums.items()],
    )
    return running.join(offsets, [*keys, "_range"]).select(
        *[F.col(k)[c].alias(c) for c, k in zip(by, keys, strict=True)],
        "value",
        "n",
        (F.col("_n_inside") + F.col("_n_before")).alias("upto"),
        F.col("_n_total").alias("total"),
        *([(F.col("_sum_inside") + F.col("_sum_before")).alias("sum_upto"),
           F.col("_sum_total").alias("sum_total")] if weigh else []),
    )


def add_ranks(
    df: DataFrame,
    ranks: dict[str, tuple[str, str]],
    *,
    key: str | None = None,
    per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Add global ranks, one column per entry ``name -> (kind, column)``.

    ``rank_desc`` is rank() over (order by column desc nulls last); ``percent_rank`` is
    percent_rank() over (order by column asc nulls last).

    With ``key``, a column that tells the rows apart, several columns are ranked in one pass: the values
    of all of them form one histogram by (column, value), and the ranks come back as one narrow row per
    key, so the rows themselves are joined once and not once per column.
    """
    columns = list(dict.fromkeys(column for _, column in ranks.values()))
    if key is None or len(columns) == 1:
        out = df
        for column in columns:
            kinds = {name: kind for name, (kind, c) in ranks.items() if c == column}
            out = _add_ranks_of(out, df, column, kinds, per_range)
        return out
    narrow = _ranks_by_key(df, ranks, columns, key, per_range)
    facts = df.agg(F.count("*").alias("_rows"), *[
        F.count(c).alias(f"_held{i}") for i, c in enumerate(columns)
    ])
    joined = df.withColumn("_key", F.struct(key)).join(narrow, "_key", "left")
    joined = attach(joined, facts).withColumns({
        name: _place(kind, name, f"_held{columns.index(c)}") for name, (kind, c) in ranks.items()
    })
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *ranks)


def _ranks_by_key(df: DataFrame, ranks: dict[str, tuple[str, str]], columns: list[str], key: str,
                  per_range: int) -> DataFrame:
    """(_key, _name...): places of every row that has a value, for all columns in one pass."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(df.dtypes)

    def value(column: str) -> Column:
        # whole numbers stay whole: beside fractions they would be rounded
        exact, none = kinds[column] in whole, F.lit(None)
        return F.struct(
            (F.col(column) if exact else none).cast("long").alias("whole"),
            (none if exact else F.col(column)).cast("double").alias("part"),
        )

    cells = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("measure"), value(c).alias("value")))
        for i, c in enumerate(columns)
    ]))
    stacked = df.select(F.struct(key).alias("_key"), F.inline(cells))
    totals = running_totals(
        stacked.groupBy("measure", "value").agg(F.count("*").alias("n")), ["measure"],
        per_range=per_range,
    )
    upto, n, total = F.col("upto"), F.col("n"), F.col("total")
    places = totals.select(
        "measure", "value", (total - upto + 1).alias("from_top"), (upto - n + 1).alias("from_end")
    )
    # every value has its places; the outer join says which side may be broadcast: never the stacked rows,
    # whose size Spark guesses too low as it does not count what the stacking adds
    return stacked.join(places, ["measure", "value"], "left").groupBy("_key").agg(*[
        F.max(F.when(F.col("measure") == columns.index(c),
                     F.col("from_top" if kind == "rank_desc" else "from_end"))).alias(f"_{name}")
        for name, (kind, c) in ranks.items()
    ])


def _place(kind: str, name: str, held: str) -> Column:
    """A rank from the place of a value; NULL matches nothing and comes after every value."""
    place = F.coalesce(F.col(f"_{name}"), F.col(held) + 1)
    if kind == "percent_rank":
        rows = F.col("_rows")
        return F.when(rows > 1, (place - 1) / (rows - 1)).otherwise(0.0)
    return place


def _add_ranks_of(
    out: DataFrame, source: DataFrame, column: str, kinds: dict[str, str], per_range: int
) -> DataFrame:
    """Ranks by one column: a value's ranks follow from its running count."""
    upto, n, total = F.col("upto"), F.col("n"), F.col("total")
    ranked = cumulative(source, column, per_range=per_range).select(
        F.col("value").alias("_key"),
        *[(total - upto + 1 if kind == "rank_desc" else upto - n + 1).alias(f"_{name}")
          for name, kind in kinds.items()],
    )
    sizes = source.agg(F.count(column).alias("_held"), F.count("*").alias("_rows"))
    joined = attach(out.join(ranked, F.col(column) == F.col("_key"), "left"), sizes)
    joined = joined.withColumns({name: _place(kind, name, "_held") for name, kind in kinds.items()})
    return joined.drop("_key", "_held", "_rows", *[f"_{name}" for name in kinds])


def quantile_columns(points: Sequence[float], *, prefix: str = "p") -> dict[str, Column]:
    """Aggregates over ``cumulative`` rows: exact quantiles, linear between neighbours."""
    total, upto, n, value = (F.col(c) for c in ("total", "upto", "n", "value"))

    def at(index: Column) -> Column:
        return F.max(F.when((upto - n <= index) & (index < upto), value.cast("double")))

    out = {}
    for p in points:
        exact = (total - 1) * F.lit(float(p))
        low, high = F.floor(exact), F.ceil(exact)
        part = F.max(exact - low)
        out[f"{prefix}{format(p * 100, 'g')}"] = at(low) + (at(high) - at(low)) * part
    return out


def quantiles(
    df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles per group, as one row per group."""
    aggregates = [c.alias(name) for name, c in quantile_columns(points).items()]
    return _totals(df, value, by).groupBy(*by).agg(*aggregates)


def describe(
    df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """count, mean, std, min, max and exact quantiles per group, all from one histogram.

    A group without any value has count 0 and NULL for the rest.
    """
    counts = _totals(df, value, by, weigh=True)
    n, total = F.col("n"), F.max("total")
    off = F.col("value") - F.col("sum_total") / F.nullif(F.col("total"), F.lit(0))
    return counts.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).alias("count"),
        (F.max("sum_total") / F.nullif(total, F.lit(0))).alias("mean"),
        F.when(total > 1, F.sqrt(F.sum(n * off * off) / F.nullif(total - 1, F.lit(0))))
        .alias("std"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        *[c.alias(name) for name, c in quantile_columns(points).items()],
    )


def top_share(counts: DataFrame, sizes: dict[str, Column]) -> DataFrame:
    """Share of the total held by the largest k rows, for several k, from weighed ``cumulative``.

    A value tied across the k-th place gives only as many rows as still fit.  ``sizes`` maps a
    label to k, an expression over ``total``.  One row per label: label, rows, share.
    """
    above = F.col("total") - F.col("upto")
    parts = []
    for label, size in sizes.items():
        size = size.cast("long")
        taken = F.greatest(F.lit(0), F.least(F.col("n"), size - above))
        parts.append(F.struct(
            F.lit(label).alias("label"),
            size.alias("k"),
            (taken * F.col("value")).cast("double").alias("held"),
        ))
    return (
        counts.select(F.explode(F.array(*parts)).alias("part"), "sum_total")
        .groupBy(F.col("part.label").alias("label"))
        .agg(
            F.max("part.k").alias("top_rows"),
            (F.sum("part.held") / F.nullif(F.max("sum_total"), F.lit(0))).alias("share"),
        )
    )


def gini(counts: DataFrame) -> DataFrame:
    """Gini coefficient from weighed ``cumulative``: 2 * sum(i * x_i) / (n * sum x) - (n + 1) / n.

    Rows i of one value are consecutive, so their places add up in closed form.
    """
    n, upto, value = F.col("n").cast("double"), F.col("upto").cast("double"), F.col("value")
    places = n * (2 * upto - n + 1) / 2
    total = F.max("total").cast("double")
    return counts.agg(
        F.max("total").alias("n_rows"),
        (2 * F.sum(places * value) / F.nullif(total * F.max("sum_total"), F.lit(0.0))
         - (total + 1) / total)
        .alias("gini"),
    )


def lorenz(counts: DataFrame) -> DataFrame:
    """(value, population_share, value_share) per distinct value, from weighed ``cumulative``."""
    return counts.select(
        "value",
        (F.col("upto") / F.col("total")).alias("population_share"),
        (F.col("sum_upto") / F.nullif(F.col("sum_total"), F.lit(0))).alias("value_share"),
    )


def cdf(counts: DataFrame) -> DataFrame:
    """Empirical distribution function: share of rows at or below each value."""
    return counts.select("value", "n", (F.col("upto") / F.col("total")).alias("cumulative_share"))


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str],
    into: str,
    *,
    sizes: DataFrame | None = None,
    largest: int | None = None,
    per_range: int = VALUES_PER_RANGE,
    keep: Keep = unkept,
) -> DataFrame:
    """0-based place of every row inside its group, in the order of ``order``.

    ``order`` must tell the rows of a group apart; only ``by`` and ``order`` are handed on.  A
    large group is spread over many ranges.  ``sizes`` (by..., size) saves counting the groups,
    ``largest`` (the greatest size) the second level of ranges where one is enough.

    Rows are no histogram, whose shuffle all steps share: ``keep`` cuts before and after the search for
    the ranges, so that neither ``df`` nor the search is worked out again by every step.
    """
    keyed = keep("keyed", df.select(*by, F.struct(*order).alias("value"), F.lit(1).alias("n")))
    totals = running_totals(
        keyed, by, per_range=per_range, distinct=sizes, largest=largest, keep=keep
    )
    return totals.select(
        *by, *[F.col("value")[c].alias(c) for c in order], (F.col("upto") - 1).alias(into)
    )
