"""From raw documents to token ids: two quality filters, near-dedup, mixing, encoding.

Each stage takes (spark, docs, folder) and returns a frame; `run` writes every stage's rows under the
shared folder and gives them to the next one.  All stages but the last return the columns of documents.
The classifiers are fitted on the labelled documents of the folder and judge the rows they are given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import boosted_rules, entropy_mix, merge_replay, simhash, subword_quality
from marquee.llm.common import keep, table

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees."""
    trees = boosted_rules.fit_on(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return boosted_rules.only_kept(docs, trees)


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the subword classifier takes for good."""
    model = subword_quality.fit_on(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return subword_quality.only_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return entropy_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of each document (unsigned 32-bit little-endian), decoded again to check them."""
    ranks = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return merge_replay.coded(docs.select("doc_id", "source", "text"), *ranks).select(
        "doc_id", "source", "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

# fitted models, components and solved multipliers: nothing here can be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
