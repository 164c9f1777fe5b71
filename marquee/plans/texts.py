"""Profiles of the item texts: lengths, repeats, characters, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import cut, percent, special_share, words_by_whitespace
from marquee.operators.distribution import attach, cumulative, describe, quantiles, top_share
from marquee.operators.explode import explode_list
from marquee.plans.profiling import box_by_group, equal_width_histogram
from marquee.plans.questions import count

# fixed value: the sentence that stands for a missing text
MISSING_TEXT = "No synopsis information has been added to this title."

# fixed values: quantiles of the summaries
DESCRIBED = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]

# fixed values: length bands, right-closed
LENGTH_EDGES = [0, 20, 50, 100, 200, 500, float("inf")]
LENGTH_BANDS = ["0-20", "21-50", "51-100", "101-200", "201-500", "500+"]

# fixed values: words left out of the frequency count
STOP_WORDS = """
the a an and or but in on at to for of with by from is are was were be been has have had do does did
will would could should may might this that these those it its his her he she they them their who
which what when where how all each every both few more most other some such no not only own same
than too very just about also into as after before between through during while if then so because
up out one two new now way can over him my our your any being there even
""".split()


def is_text(c: Column) -> Column:
    return F.coalesce((c != "") & (c != MISSING_TEXT), F.lit(False))


def measured(texts: DataFrame) -> DataFrame:
    """What the profiles need to know of each usable text, from one reading of it.

    Length, words, share of special characters, and the SHA-256 that stands for the text where
    copies are counted, so that no text goes through a shuffle.
    """
    text = F.col("text")
    return texts.filter(is_text(text)).select(
        "item_id", "tags", "score",
        F.length(text).cast("long").alias("text_length"),
        words_by_whitespace(text).alias("word_count"),
        special_share(text).alias("special_share"),
        F.sha2(text, 256).alias("digest"),
    )


def presence(texts: DataFrame) -> DataFrame:
    """How many items have a usable text, and how the scores compare."""
    label = F.when(is_text(F.col("text")), "has text").otherwise("no text")
    return texts.groupBy(label.alias("presence")).agg(
        count("item_count"), F.avg("score").alias("avg_score")
    )


def score_by_presence(texts: DataFrame) -> DataFrame:
    """Quartiles, extremes and count of the scores with and without a usable text."""
    label = F.when(is_text(F.col("text")), "has text").otherwise("no text")
    return box_by_group(texts.select(label.alias("presence"), "score"), "score", "presence")


def text_share(texts: DataFrame) -> DataFrame:
    """How many items have a usable text, and their share."""
    held = F.count_if(is_text(F.col("text")))
    return texts.agg(held.alias("item_count"), percent(held, F.count("*")).alias("item_pct"))


def length_stats(measures: DataFrame) -> DataFrame:
    """Summary of length and of words, one row each."""
    long = measures.select(F.inline(F.array(
        F.struct(F.lit("text_length").alias("measure"), F.col("text_length").alias("value")),
        F.struct(F.lit("word_count").alias("measure"), F.col("word_count").alias("value")),
    )))
    return describe(long, "value", DESCRIBED, ["measure"])


def short_shares(measures: DataFrame) -> DataFrame:
    """The 10% quantile of the word counts, and the shares at or below 10 and 50 words."""
    shares = measures.agg(*[
        percent(F.count_if(F.col("word_count") <= n), F.count("*")).alias(f"upto_{n}_pct")
        for n in (10, 50)
    ])
    low = quantiles(measures, "word_count", [0.1]).select(F.floor("p10").alias("p10_words"))
    return attach(shares, low)


def clipped_histogram(measures: DataFrame, bins: int = 50, point: float = 0.99) -> DataFrame:
    """Word counts with everything above a quantile moved to it."""
    bound = quantiles(measures, "word_count", [point]).toDF("bound")
    clipped = F.least(F.col("word_count").cast("double"), F.col("bound"))
    return equal_width_histogram(attach(measures, bound), clipped, bins)


def length_by_tag(measures: DataFrame, min_items: int = 100) -> DataFrame:
    listed = explode_list(measures, "tags", "tag", delimiter=", ").select("tag", "word_count")
    middle = quantiles(listed, "word_count", [0.5], ["tag"]).withColumnRenamed(
        "p50", "median_words"
    )
    means = listed.groupBy("tag").agg(count("item_count"), F.avg("word_count").alias("avg_words"))
    return means.filter(F.col("item_count") >= min_items).join(middle, "tag")


def score_by_length(measures: DataFrame) -> DataFrame:
    band = cut(F.col("word_count"), LENGTH_EDGES, LENGTH_BANDS)
    scored = measures.filter(F.col("score").isNotNull())
    return scored.groupBy(band.alias("length_band")).agg(
        F.avg("score").alias("avg_score"),
        count("item_count"),
        F.stddev("score").alias("std_score"),
    )


def length_score_correlation(measures: DataFrame) -> DataFrame:
    return measures.filter(F.col("score").isNotNull()).agg(
        F.corr(F.col("word_count").cast("double"), F.col("score")).alias("correlation")
    )


def _copies(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(count("copies"), F.min("item_id").alias("first_item"))


def repeated(measures: DataFrame) -> DataFrame:
    return _copies(measures).agg(
        F.sum("copies").alias("text_count"),
        F.sum(F.col("copies") - 1).alias("duplicate_count"),
        (100.0 * F.sum(F.col("copies") - 1) / F.sum("copies")).alias("duplicate_pct"),
    )


def most_repeated(texts: DataFrame, k: int = 5) -> DataFrame:
    """The k texts with the most copies, whole; only those k are fetched again."""
    digests = texts.filter(is_text(F.col("text"))).select(
        "item_id", F.sha2("text", 256).alias("digest")
    )
    top = _copies(digests).orderBy(F.desc("copies"), "digest").limit(k).select("digest", "copies")
    fetched = texts.select(F.sha2("text", 256).alias("digest"), "text").join(F.broadcast(top), "digest")
    return fetched.groupBy("copies", "digest").agg(F.min("text").alias("text"))


def special_characters(measures: DataFrame) -> DataFrame:
    return describe(measures, "special_share", [0.75, 0.9, 0.95, 0.99])


def word_counts(texts: DataFrame, min_length: int = 3) -> DataFrame:
    """Occurrences of every word of the usable texts, stop words left out."""
    held = texts.filter(is_text(F.col("text")))
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return (
        held.select(F.explode(words).alias("word"))
        .filter((F.length("word") >= min_length) & ~F.col("word").isin(STOP_WORDS))
        .groupBy("word")
        .agg(count("word_count"))
    )


def frequent_words(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.orderBy(F.desc("word_count"), "word").limit(k)


def vocabulary(counts: DataFrame, top: int = 5000) -> DataFrame:
    """Vocabulary size, and the share of all words that the most frequent ones make up."""
    counts = cumulative(counts, "word_count", weigh=True)
    size = counts.agg(F.max("total").alias("vocabulary_size"), F.max("sum_total").alias("words"))
    share = top_share(counts, {"top": F.lit(top)}).select(
        (100.0 * F.col("share")).alias("coverage_pct")
    )
    return attach(size, share)
