"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words.  Among all document rates r >= 0 that meet the targets and
do not exceed the cap, those closest to one copy each (in relative entropy) are
``r = min(cap, exp(l * x))``, x being the document's words over its source's mean, with one multiplier
l per source.  The multipliers solve the convex dual.  Each Newton iteration is one aggregate over the
histogram (source, words, documents), which holds all that the dual depends on; steps that leave the
bracket of the root are replaced by halving it.

Rates become copies by one threshold per source.  A document has floor(r) copies, and one more if a
hash of it in [0, 1) exceeds its fraction r - floor(r) by less than the threshold.  The threshold, near
0, is read off histograms of that excess so that the words taken meet the target as nearly as the
histogram's last bin allows.

Defined results: NULL, empty and blank texts have no words, rate 1 and nothing to take; a NULL source
is a source of its own, last in order; rows alike in id, source and text are counted and draw one by one,
so a source of repeats is mixed like any other; sources without words have target 0; further columns
go through `mixed` under their own names, also if they are called like those used here; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marquee.llm.common import WORD, forget, keep
from marquee.operators.distribution import number_rows

# fixed values: the weights by turns, the size of the mix, the most copies of a document
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0

MAX_NEWTON = 60
TOLERANCE = 1e-9
BINS = 4096
# equal rows that one task makes from their count
CHUNK = 1000
# parameters of at most so many sources are sent to all executors; beyond, they are joined by source
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP,
            weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add weight and target to (source, source_size).

    Weights go round in the order of the sources.  A target is the common level times the weight, but
    at most ``cap`` sizes; the level rises until the rest of the words is dealt to the others.
    """
    placed = number_rows(
        sources.select(F.col("source").isNull().alias("last"), "source"), ["last", "source"], [], "place"
    )
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighed = keep(
        sources.join(placed, sources["source"].eqNullSafe(placed["source"])).select(
            sources["source"], "source_size",
            F.get(turns, (F.col("place") % len(weights)).cast("int")).alias("weight"),
        ),
        "weights",
    )
    most = F.col("source_size") * cap
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, None
    while level != before:
        before = level
        full = most <= F.col("weight") * level
        held, weight = weighed.agg(
            F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not weight:
            break
        level = max(level, (total - float(held or 0)) / float(weight))
    return weighed.withColumn("target", F.least(most, F.col("weight") * level))


def _rate(multiplier: str, size: str, mean: str, full: str) -> Column:
    tilted = F.least(F.lit(CAP), F.exp(F.least(F.lit(1.0), F.col(multiplier) * F.col(size) / F.col(mean))))
    return F.when(F.col(full), CAP).otherwise(F.coalesce(tilted, F.lit(1.0)))


def _joined(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def solve(histogram: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Add ``multiplier`` to (source, source_size, target, mean, smallest, full)."""
    ratio = F.log(F.col("target") / F.col("source_size"))
    shrinks = F.col("target") < F.col("source_size")
    scale = F.col("mean") / F.col("smallest")
    start = keep(sources.select(
        "*", F.lit(0.0).alias("multiplier"),
        F.when(shrinks, ratio * scale).otherwise(0.0).alias("low"),
        F.when(shrinks, 0.0).otherwise(F.log(F.lit(CAP)) * scale).alias("high"),
    ), "multipliers")
    # only sources with words, and not taken whole as often as they may be, have something to solve;
    # their state goes through the aggregate, so a step joins once and is one job
    carried = ["mean", "smallest", "target", "low", "high", "multiplier"]
    state, x = start.filter("not full"), F.col("size") / F.col("mean")
    for step_no in range(MAX_NEWTON):
        rate = _rate("multiplier", "size", "mean", "full")
        words = F.col("n") * F.col("size") * rate
        sums = _joined(histogram, state, n_sources).groupBy("source").agg(
            F.sum(words).alias("words"),
            F.sum(F.when(rate < CAP, words * x).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in carried],
        )
        off = F.log(F.col("words") / F.col("target"))
        low = F.when(off <= 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(off >= 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - off * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton >= low) & (newton <= high)
        step = F.when(off.isNull() | (F.abs(off) < TOLERANCE), F.col("multiplier")).when(
            inside, newton).otherwise((low + high) / 2)
        worst, before = Observation(), state
        state = keep(sums.select(
            "source", "mean", "smallest", "target", low.alias("low"), high.alias("high"),
            step.alias("multiplier"), F.lit(False).alias("full"), off.alias("off"),
        ).observe(worst, F.max(F.abs("off")).alias("off")).drop("off"), "multipliers")
        if step_no:
            forget(before)
        if (worst.get["off"] or 0.0) < TOLERANCE:
            break
    solved = state.select(F.col("source").alias("of"), F.col("multiplier").alias("found"))
    state = start.join(solved, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "multiplier", F.coalesce("found", "multiplier"))
    # the last digits depend on the order of summation
    return state.select(*sources.columns, F.round("multiplier", 9).alias("multiplier"))


def _copies(draw: Column) -> tuple[Column, Column]:
    """Whole copies, and by how much the draw exceeds the fraction (NULL where a copy more is too many)."""
    rate = _rate("multiplier", "size", "mean", "full")
    whole = F.floor(rate)
    return whole, F.when(rate < CAP, draw - (rate - whole))


def thresholds(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Add ``threshold`` per source: a copy more goes to rows whose excess is below it."""
    low, width = F.lit(-1.0), 2.0
    found = sources.select("*", low.alias("threshold"))
    for step in range(2):
        whole, excess = _copies(F.col("draw"))
        width /= BINS
        cell = F.floor((F.col("excess") - F.col("threshold")) / width)
        judged = _joined(rows, found, n_sources).select(
            "source", "size", whole.alias("whole"), excess.alias("excess"), "threshold"
        )
        # below the threshold are words that are taken already
        taken = F.col("size") * (F.col("whole") + F.when(F.col("excess") < F.col("threshold"), 1).otherwise(0))
        known = judged.groupBy("source").agg(F.sum(taken).alias("taken"))
        cells = (
            judged.withColumn("cell", cell).filter(F.col("cell").between(0, BINS - 1))
            .groupBy("source", "cell").agg(F.sum("size").alias("more"))
        )
        cells = cells.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        cells = _joined(cells, found.select("source", "target", "threshold"), n_sources)
        upto = F.sum("more").over(Window.partitionBy("source").orderBy("cell"))
        cells = cells.withColumn("upto", F.col("taken") + upto)
        # first round: cells that fit wholly; last round: the cell that crosses too, if that is nearer
        fits = F.col("upto") <= F.col("target")
        if step:
            over = F.col("upto") - F.col("target")
            fits = fits | (over < F.col("more") - over)
        # the cells that fit come first; empty ones between two are no cells, so the next threshold is
        # where the first one that does not fit begins
        best = cells.groupBy("source").agg(F.min(F.when(~fits, F.col("cell"))).alias("cell"))
        best = best.withColumnRenamed("source", "s")
        found = keep(
            found.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select(
                *sources.columns,
                (F.col("threshold") + F.coalesce("cell", F.lit(BINS)) * width).alias("threshold"),
            ),
            "thresholds",
        )
    return found


@dataclass
class Mix:
    """What decides the copies of a document: one row per source."""

    sources: DataFrame
    n_sources: int


def _draw(told: str, copy: Column) -> Column:
    return F.pmod(F.xxhash64(told, copy), F.lit(1 << 40)) / float(1 << 40)


def _repeated(rows: DataFrame, times: str, into: str) -> DataFrame:
    """Every row as often as it says, numbered from 0; a hot row is expanded by many tasks."""
    few = F.sequence(F.lit(0).cast("long"), F.col(times) - 1)
    plain = rows.filter(F.col(times).between(1, CHUNK)).withColumn(into, F.explode(few))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / CHUNK))
    first = F.col("_chunk") * CHUNK
    hot = (
        rows.filter(F.col(times) > CHUNK).withColumn("_chunk", F.explode(chunks))
        .repartition(*[c for c in rows.columns if dict(rows.dtypes)[c] == "bigint"], "_chunk")
        .withColumn(into, F.explode(F.sequence(first, F.least(first + CHUNK, times) - 1)))
    )
    return plain.unionByName(hot.select(*plain.columns))


ALIKE = ["doc_id", "source", "text"]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, told, n, draw), the narrow rows on which the mix is settled.

    Rows that agree in id, source and text are counted and then drawn one by one, by their hash and
    their number.
    """
    told = F.xxhash64(*ALIKE)
    packed = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        told.alias("told"),
    ).groupBy("told", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    return _repeated(packed, "n", "copy").select(
        "doc_id", "source", "size", "told", "n", _draw("told", F.col("copy")).alias("draw")
    )


def balance(rows: DataFrame) -> Mix:
    """Settle the mix for rows made by `sized`."""
    histogram = keep(
        rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes"
    )
    sums = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"),
        F.min("size").alias("smallest"),
    ).withColumnRenamed("source", "s")
    every = rows.select("source").distinct()
    totals = keep(every.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", F.coalesce("words", F.lit(0)).alias("source_size"),
        (F.col("words") / F.col("n")).alias("mean"), "smallest",
    ), "totals")
    aimed = targets(totals.select("source", "source_size"))
    aimed = aimed.withColumnRenamed("source", "s").select("s", "target")
    full = (F.col("target") > 0) & (F.col("target") >= F.col("source_size") * CAP * (1 - 1e-12))
    known = keep(totals.join(aimed, F.col("source").eqNullSafe(F.col("s"))).drop("s")
                 .withColumn("full", full), "targets")
    n_sources = known.count()
    return Mix(thresholds(rows, solve(histogram, known, n_sources), n_sources), n_sources)


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """Add copies, source_size and target to rows that have source, size and draw."""
    whole, excess = _copies(F.col("draw"))
    more = F.when(excess < F.col("threshold"), 1).otherwise(0)
    return _joined(rows, mix.sources, mix.n_sources).select(
        *rows.columns, "source_size", "target", (whole + more).cast("long").alias("copies")
    )


def taken_words(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = keep(sized(docs), "sized")
    return with_copies(rows, balance(rows)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "source",
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Rows that are alone draw where they stand.  Of rows alike in id, source and text one goes on as
    often as all of them are taken.
    """
    rows = keep(sized(docs), "sized")
    mix = balance(rows)
    packed = docs.select(
        F.struct(*docs.columns).alias("row"), F.xxhash64(*ALIKE).alias("told"),
        F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
    ).withColumn("draw", _draw("told", F.lit(0).cast("long")))
    alike = keep(
        with_copies(rows.filter("n > 1"), mix).groupBy("told")
        .agg(F.sum("copies").alias("times")), "alike",
    )
    n_alike = alike.count()
    if not n_alike:
        taken = with_copies(packed, mix).withColumnRenamed("copies", "times")
        return _repeated(taken.select("row", "times"), "times", "copy").select("row.*")
    small = F.broadcast(alike) if n_alike <= BROADCAST_SOURCES else alike
    alone = with_copies(packed.join(small.select("told"), "told", "left_anti"), mix)
    one_of = packed.join(small, "told").dropDuplicates(["told"])
    taken = alone.select("row", F.col("copies").alias("times")).unionByName(one_of.select("row", "times"))
    return _repeated(taken, "times", "copy").select("row.*")
