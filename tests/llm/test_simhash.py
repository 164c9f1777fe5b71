from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from marquee.llm import simhash


def plain_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> list[int]:
    """Place of the first row that each row reaches."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components_are_those_of_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    prints = [plain_print(t) for t in texts]
    label = plain_components(prints)
    for i, number in enumerate(prints):
        assert found[i]["fingerprint"] == f"{number:016x}"
        assert found[i]["component_id"] == label[i]


def test_no_link_within_three_bits_is_missed(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(150):
        base = r.getrandbits(64)
        prints.add(base)
        for _ in range(4):
            near = base
            for b in r.sample(range(64), r.randint(1, 5)):
                near ^= 1 << b
            prints.add(near)
    prints |= {0, 1, 3, 2**64 - 1, 2**63, 2**63 | 7}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    pairs = {frozenset((row["a"], row["b"])) for row in found}
    wanted = {frozenset((a, b)) for a in signed for b in signed
              if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert pairs == wanted


def test_odd_rows(docs, no_docs):
    found = simhash.near_duplicates(docs)
    assert found.count() == docs.count()
    blank = found.filter("doc_id < 3").select("fingerprint", "component_id").distinct().collect()
    assert [tuple(r) for r in blank] == [("0" * 16, 0)]
    alone = found.filter("doc_id is null").select("component_id").distinct().collect()
    assert [r[0] for r in alone] == [None]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_component_stays(docs, no_docs):
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    components = simhash.near_duplicates(docs)
    wanted = components.select(F.coalesce("component_id", F.lit(-1))).distinct().count()
    assert kept.count() == wanted
    assert {r[0] for r in kept.select("doc_id").collect()} == {
        r[0] for r in components.select("component_id").distinct().collect()}
    assert simhash.without_near_duplicates(no_docs).count() == 0


def test_unrelated_fingerprints_hardly_meet(spark):
    r = random.Random(6)
    prints = [r.getrandbits(64) - 2**63 for _ in range(3000)]
    points = spark.createDataFrame([(p,) for p in prints], "print long")
    assert simhash.links(points).count() == 0
    # the ring of counts tells 32 bits apart but for alternating ones
    halves = [0, 1, 2**31, 2**32 - 1, 0x55555555, 0xAAAAAAAA, *(r.getrandbits(32) for _ in range(500))]
    found = spark.createDataFrame([(h,) for h in halves], "h long").select("h", simhash._cell(F.col("h")))
    by_cell: dict[int, set[int]] = {}
    for half, cell in found.collect():
        ring = sum(((half >> i & 1) + (half >> (i + 1) % 32 & 1)) << 2 * i for i in range(32))
        assert cell & (2**64 - 1) == ring
        by_cell.setdefault(cell, set()).add(half)
    assert [c for c in by_cell.values() if len(c) > 1] == [{0x55555555, 0xAAAAAAAA}]


def joins_of(spark, make):
    """The joins of a plan from the outermost, were Spark to broadcast whatever it may."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return re.findall(r"(\w+Join) ", plan)


def test_cells_are_never_broadcast(spark):
    """Every point has up to 33 cells a half, which Spark's guess of their size leaves out."""
    # a range, whose size Spark knows; it takes rows from Python for too large to be broadcast
    points = spark.range(200).select((F.col("id") * 0x9E3779B97F4A7C).alias("print"))
    assert joins_of(spark, lambda: simhash.links(points)) == ["SortMergeJoin"]


def test_rows_are_never_broadcast(spark, docs):
    """The outermost join is that of the rows."""
    assert joins_of(spark, lambda: simhash.near_duplicates(docs))[0] == "SortMergeJoin"
