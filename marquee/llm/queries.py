"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    boosted_rules,
    causal_lm,
    entropy_mix,
    hash_tree,
    host_paths,
    merge_replay,
    projection_forest,
    simhash,
    sql,
    subword_quality,
    token_alignment,
    token_store,
    turn_repair,
    weak_toxicity,
)
from marquee.llm.common import crc_of, table

Query = Callable[[SparkSession, str], DataFrame]


RANKS = "byte_bpe_50k.tiktoken"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return projection_forest.near_duplicates(table(spark, folder, "embeddings"))


def op2_weak_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_of("doc_id") % 4 == 2
    model = weak_toxicity.fit_on(docs, table(spark, folder, "labels"), ~held_out)
    return weak_toxicity.add_score(docs, model, "score").select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= weak_toxicity.PREDICT_FROM).cast("int").alias("predicted"),
    )


def op3_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_of("doc_id") % 5 == 0
    model = subword_quality.fit_on(docs, table(spark, folder, "labels"), ~held_out)
    return subword_quality.add_score(docs, model, "score").select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= subword_quality.KEEP_FROM).cast("int").alias("predicted"),
    )


def op4_entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    return entropy_mix.taken_words(table(spark, folder, "documents"))


def op5_causal_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = crc_of("doc_id") % 7 == 2
    ranks = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return causal_lm.score(docs, held_out, causal_lm.fit(docs, held_out, *ranks), *ranks)


def op6_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hash_tree.shard_rows(table(spark, folder, "documents"), hash_tree.even_tree())


def op7_merge_replay(spark: SparkSession, folder: str) -> DataFrame:
    return merge_replay.digests(
        table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )


def op8_host_paths(spark: SparkSession, folder: str) -> DataFrame:
    return host_paths.main_texts(table(spark, folder, "pages"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_boosted_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trees = boosted_rules.fit_on(docs, table(spark, folder, "labels"))
    return boosted_rules.rated(docs, trees)


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair(table(spark, folder, "conversations"))


def op12_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_store.digests(token_store.stored(docs, public_tokenizers.path(BYTE_LEVEL)))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.aligned(
        table(spark, folder, "documents"), public_tokenizers.path(BYTE_LEVEL),
        public_tokenizers.path(PIECES),
    )


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_projection_forest, op2_weak_toxicity, op3_subword_quality, op4_entropy_mix, op5_causal_lm,
        op6_hash_tree, op7_merge_replay, op8_host_paths, op9_simhash, op10_boosted_rules, op11_turn_repair,
        op12_token_store, op13_token_alignment,
    )}


def all_sql() -> dict[str, str]:
    return dict(sql.ALL)
