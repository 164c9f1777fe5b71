from __future__ import annotations

import math

from pyspark.sql import functions as F

from marquee.llm import entropy_mix
from tests.llm.conftest import DOC_SCHEMA, prose


def plain_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weights[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def many(spark):
    rows = [(i, prose(i, 5 + i * 7 % 90), "en", ["b", None, "a", "Z", "ä", "b", "b"][i % 7], 0)
            for i in range(900)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)


def test_a_source_of_one_repeated_row_meets_its_target(spark):
    """3,000 equal rows draw one by one: before, all were taken or none."""
    rows = [(7, "six words in every single copy", "en", "b", 0)] * 3000
    rows += [(i, prose(i, 20), "en", "ac"[i % 2], 0) for i in range(1000, 1400)]
    rows += [(None, None, None, None, None)] * 50
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    found = entropy_mix.taken_words(docs).collect()
    assert len(found) == len(rows)
    for source in "abc":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = entropy_mix.taken_words(docs.coalesce(1)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    mixed = entropy_mix.mixed(docs)
    per_source = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    taken = sum(r["taken"] for r in found if r["source"] == "b") // 6
    assert abs(per_source["b"] - taken) <= 1
    assert mixed.columns == docs.columns


def test_a_step_of_the_solution_is_one_job(spark, monkeypatch):
    """Each step joins once, by broadcast; before, its state was joined again and asked by a second job."""
    plans = []

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label)

    keep = entropy_mix.keep
    monkeypatch.setattr(entropy_mix, "keep", kept)
    entropy_mix.balance(keep(entropy_mix.sized(many(spark)), "sized"))
    steps = [plan for label, plan in plans if label == "multipliers"][1:]
    assert len(steps) > 2
    assert {len([line for line in plan.split("\n") if "Join" in line]) for plan in steps} == {1}


def test_columns_with_names_used_inside(spark):
    rows = [(i, prose(i % 40, 9), "ab"[i % 2], 1, 2, "x", 3) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, told int, copies int,"
                                       " row string, size int")
    assert entropy_mix.taken_words(docs).count() == 80
    mixed = entropy_mix.mixed(docs)
    assert mixed.columns == docs.columns and mixed.filter("told <> 1 or size <> 3").count() == 0


def test_targets_are_met_and_no_document_is_taken_more_than_twice(spark):
    found = entropy_mix.taken_words(many(spark)).collect()
    sizes: dict = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = plain_targets(sizes)
    longest = max(r["size"] for r in found)
    for source, size in sizes.items():
        own = [r for r in found if r["source"] == source]
        assert all(r["source_size"] == size for r in own)
        assert all(math.isclose(r["target"], targets[source], rel_tol=1e-9) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[source]) <= longest
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert {2.0 * s for s in sizes.values()} & set(targets.values())  # some source is capped


def test_rates_solve_the_dual(spark):
    rows = entropy_mix.sized(many(spark)).filter("size > 0")
    mix = entropy_mix.balance(rows)
    rate = entropy_mix._rate("multiplier", "size", "mean", "full")
    joined = entropy_mix._joined(rows, mix.sources, mix.n_sources)
    for r in joined.groupBy("source").agg(
        F.sum(F.col("size") * rate).alias("words"), F.first("target").alias("target")
    ).collect():
        assert math.isclose(r["words"], r["target"], rel_tol=1e-6)


def test_reruns_and_partitionings_agree(spark):
    df = many(spark)
    first = entropy_mix.taken_words(df).select("doc_id", "taken").collect()
    again = entropy_mix.taken_words(df.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(first) == sorted(again)


def test_odd_rows(docs, no_docs):
    found = entropy_mix.taken_words(docs)
    assert found.count() == docs.count()
    assert found.filter("size = 0 and taken <> 0").count() == 0
    assert found.filter("taken > 2 * size").count() == 0
    copies = found.agg(F.sum("copies")).first()[0]
    mixed = entropy_mix.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert entropy_mix.taken_words(no_docs).count() == 0


def test_parameters_of_many_sources_are_joined_instead_of_sent(spark, monkeypatch):
    df = many(spark)
    sent = sorted(entropy_mix.taken_words(df).select("doc_id", "taken").collect())
    monkeypatch.setattr(entropy_mix, "BROADCAST_SOURCES", 0)
    assert sorted(entropy_mix.taken_words(df).select("doc_id", "taken").collect()) == sent
