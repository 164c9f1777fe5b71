from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marquee.llm import hash_tree


def numbers(spark, n=4000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_slots_have_no_gaps_and_sizes_are_bytes(docs, no_docs):
    found = hash_tree.shard_rows(docs, hash_tree.even_tree())
    assert found.count() == docs.count()
    for row in found.groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")
    ).collect():
        assert row["last"] == row["n"] - 1 and row["slots"] == row["n"]
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert (by_id[0]["size"], by_id[0]["text_crc32"]) == (1, 0)
    assert by_id[5]["size"] == len("Héé 日本 ß".encode()) + 1
    assert found.filter("doc_id is null").select("shard").distinct().count() == 1
    assert hash_tree.shard_rows(no_docs, hash_tree.even_tree()).count() == 0


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = hash_tree.even_tree()
    both = hash_tree.add_shard(numbers(spark), "doc_id", tree)
    both = hash_tree.add_shard(both, "doc_id", hash_tree.grown(tree), "r", "k", "grown")
    moved = both.filter("shard <> grown")
    assert [r[0] for r in moved.select("grown").distinct().collect()] == [8]
    assert 300 < moved.count() < 600  # a ninth of 4000
    sizes = [r["count"] for r in both.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and min(sizes) > 400 and max(sizes) < 600


def test_a_changed_weight_moves_rows_only_through_its_subtrees(spark):
    tree = hash_tree.even_tree()
    heavier = [replace(s, weight=3.0) if s.shard == 5 else s for s in tree]
    both = hash_tree.add_shard(numbers(spark), "doc_id", tree)
    both = hash_tree.add_shard(both, "doc_id", heavier, "r2", "k2", "s2")
    # regions: rows only come into the region that grew
    assert both.filter("region <> r2 and r2 <> 1").count() == 0
    # racks: within the region, only into the rack that grew; shards: only into the shard
    assert both.filter("region = r2 and region = 1 and rack <> k2 and k2 <> 0").count() == 0
    assert both.filter("region = r2 and rack = k2 and shard <> s2 and s2 <> 5").count() == 0
    assert both.filter("region = 0 and r2 = 0 and shard <> s2").count() == 0
    share = both.filter("s2 = 5").count() / 4000
    assert abs(share - 3 / 10) < 0.04


def test_a_hot_row_is_expanded_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "CHUNK_ROWS", 7, raising=False)
    df = spark.createDataFrame([(1, "a")] * 100 + [(2, "a"), (3, "b")], "id int, shard string")
    found = hash_tree.add_slots(df, "shard").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["slot"] for r in found if r["shard"] == "a") == list(range(101))
    assert [r["slot"] for r in found if r["shard"] == "b"] == [0]
    assert sum(r["id"] == 1 for r in found) == 100
    assert len({r["task"] for r in found if r["id"] == 1}) > 1
