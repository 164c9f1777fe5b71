from __future__ import annotations

import numpy as np
import pytest

from marquee.llm import projection_forest

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, leaf string, vector string"


def clustered(seed: int, sizes: list[int], alone: int, width: int = 32) -> list[list[float]]:
    r = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = r.normal(size=width)
        rows += [centre + r.normal(size=width) * r.choice([0.05, 0.2]) for _ in range(size)]
    rows += list(r.normal(size=(alone, width)))
    rows = [rows[i] for i in r.permutation(len(rows))]
    return [[float(np.float32(x)) for x in row] for row in rows]


def plain(ids, vectors):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    label = np.array(ids)
    while True:
        lower = np.where(linked, label[None, :], max(ids)).min(axis=1)
        if (lower == label).all():
            return linked.sum(axis=1) - 1, label
        label = lower


@pytest.mark.parametrize("most", [2048, 48])  # 48: leaves are split in rounds and compared in blocks
def test_links_and_components_are_those_of_brute_force(spark, most):
    vectors = clustered(1, [150, 40, 9, 2, 2, 3], 250)
    vectors += vectors[:30] + [[2 * v for v in vectors[31]]]  # copies, and one of another length
    ids = list(range(10, 10 + len(vectors)))
    df = spark.createDataFrame(
        [(i, v, 0, 1, "a", "b") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)
    found = {r["vec_id"]: r for r in projection_forest.near_duplicates(
        df, leaf_rows=24, most=most, sample_rows=300).collect()}
    links, label = plain(ids, vectors)
    got = np.array([found[i]["n_links"] for i in ids])
    assert (got <= links).all()
    assert got.sum() >= 0.98 * links.sum()
    assert [found[i]["component_id"] for i in ids] == label.tolist()
    assert all(found[i]["kept"] == (i == c) for i, c in zip(ids, label, strict=True))


def test_odd_vectors_link_with_nothing(spark):
    one, inf, nan = [1.0, 0.0], float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0], [None, 1.0], [inf, 1.0], [nan, 1.0], [1.0, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(20, one), (21, one), (21, one), (22, [1e30, 1.0])]
    rows += [(None, one), (23, [1e-30, 0.0]), (24, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = projection_forest.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert all(by_id[i] == (0, i, True) for i in [*range(len(odd)), 24])
    # a row without vec_id counts as a partner and names no component
    assert by_id[None] == (5, 20, False)
    assert all(by_id[i] == (5, 20, i == 20) for i in (20, 21, 22, 23))
    nameless = spark.createDataFrame([(None, one), (None, one), (1, [0.0, 1.0])], df.schema)
    found = projection_forest.near_duplicates(nameless).orderBy("vec_id").collect()
    assert [tuple(r) for r in found] == [(None, 1, None, False)] * 2 + [(1, 0, 1, True)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert projection_forest.near_duplicates(empty).count() == 0


def test_pairs_that_share_leaves_count_once():
    earlier = [np.array([1, 5]), np.array([5]), np.array([7]), np.array([], int)]
    together = projection_forest._shared(earlier, np.arange(4))
    assert together[0, 1] and not together[0, 2] and not together[2, 3]


def test_vectors_under_one_id_join_their_components(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (3, [2.0, 0.0]), (9, [0.0, 3.0]), (1, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = projection_forest.near_duplicates(df).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in found) == [(1, 1), (3, 3), (7, 3), (7, 3), (9, 3)]


@pytest.mark.parametrize(("hot", "alone"), [(100_000, 0), (40_000, 80_000)])
def test_a_hot_cluster_keeps_its_pairs_and_few_leaf_rows(hot, alone):
    r = np.random.default_rng(4)
    centre = r.normal(size=64)
    rows = np.concatenate([centre + 0.2526 * r.normal(size=(hot, 64)), r.normal(size=(alone, 64))])
    rows = projection_forest.unit(rows)
    sample = rows[r.permutation(len(rows))[:projection_forest.SAMPLE_ROWS]]
    forest = projection_forest.Forest(sample, len(rows), 0.95, projection_forest.TREES,
                                      projection_forest.LEAF_ROWS)
    owners, leaves = forest.leaves(rows)
    assert len(owners) < 50 * len(rows)
    order = np.argsort(owners, kind="stable")
    leaves, ends = leaves[order], np.searchsorted(owners[order], np.arange(len(rows) + 1))
    a, b = r.integers(0, hot, (2, 40_000))
    near = (np.einsum("ij,ij->i", rows[a], rows[b]) >= 0.95) & (a != b)
    together = [bool(np.intersect1d(leaves[ends[i]:ends[i + 1]], leaves[ends[j]:ends[j + 1]]).size)
                for i, j in zip(a[near], b[near], strict=True)]
    assert len(together) > 2000 and np.mean(together) >= 0.9


def test_a_cluster_is_compared_in_blocks_once_for_all_trees(spark):
    vectors = clustered(6, [700], 500, width=16)
    ids = list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r for r in projection_forest.near_duplicates(
        df, leaf_rows=24, most=90, sample_rows=400).collect()}
    links, label = plain(ids, vectors)
    got = np.array([found[i]["n_links"] for i in ids])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum()
    assert [found[i]["component_id"] for i in ids] == label.tolist()
