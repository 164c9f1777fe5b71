from __future__ import annotations

from marquee.llm.common import components


def test_chains_stars_loops_and_repeats(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = [*chain, *star, (7, 7), (9, 8), (8, 9), (9, 8), (-5, 3), (559, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = dict(tuple(r) for r in components(df).collect())
    wanted = {n: 100 for n in [*range(100, 161), *range(500, 560)]} | {8: 8, 9: 8, -5: -5, 3: -5}
    assert found == wanted


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
