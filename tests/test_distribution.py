"""Ranges against plain windows and numpy, on skewed values with ties and NULLs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import distribution as d


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, some have none, the rest spread widely."""
    rng = random.Random(7)
    data = []
    for i in range(6000):
        kind = i % 6
        value = 500 if kind < 2 else None if kind == 2 and i % 5 == 0 else rng.randrange(4000)
        data.append((i, "hot" if i % 3 else f"g{i % 7}", value, rng.random() * 10))
    df = spark.createDataFrame(data, "id int, grp string, v int, x double")
    return df.repartition(5).cache()


def test_many_ranges_equal_the_plain_window(skewed, rows):
    ranks = {"r": ("rank_desc", "v"), "p": ("percent_rank", "v"), "q": ("percent_rank", "x")}
    everything = Window.partitionBy(F.lit(0))
    plain = skewed.withColumns({
        "r": F.rank().over(everything.orderBy(F.desc_nulls_last("v"))).cast("long"),
        "p": F.percent_rank().over(everything.orderBy(F.asc_nulls_last("v"))),
        "q": F.percent_rank().over(everything.orderBy(F.asc_nulls_last("x"))),
    })
    for per_range in (50, 2):  # 2: some three thousand ranges
        for key in (None, "id"):
            ranged = d.add_ranks(skewed, ranks, key=key, per_range=per_range)
            assert rows(ranged, "id", "r", "p", "q") == rows(plain, "id", "r", "p", "q")


def test_whole_numbers_beyond_doubles_keep_their_order(spark, rows):
    data = [(i, (1 << 60) + i % 3, i / 7) for i in range(9)]
    df = spark.createDataFrame(data, "id int, v long, x double")
    found = d.add_ranks(df, {"r": ("rank_desc", "v"), "q": ("rank_desc", "x")}, key="id")
    assert rows(found, "id", "r", "q") == [(i, (7, 4, 1)[i % 3], 9 - i) for i in range(9)]


def test_a_hundred_thousand_ranges(spark):
    """One value a range: both levels of cut points are in use, and no sample is large."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 1_000_003).alias("v"))
    counts = d.running_totals(d.histogram(df, "v"), per_range=1)
    checked = counts.withColumn("plain", F.count("*").over(Window.partitionBy(F.lit(0)).orderBy("value")))
    assert checked.filter("upto <> plain or total <> 100000").count() == 0


def test_nulls_rank_last_both_ways(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, None), (5, 5)], "id int, v int")
    expected = [(1, 2, 0.0), (2, 4, 0.75), (3, 1, 0.5), (4, 4, 0.75), (5, 2, 0.0)]
    ranks = {"r": ("rank_desc", "v"), "p": ("percent_rank", "v")}
    for found in (d.add_ranks(df, ranks), d.add_ranks(df, ranks, per_range=1)):
        assert rows(found, "id", "r", "p") == expected


@pytest.mark.parametrize("data", [[(1, 3)], [(1, 3), (2, 3)], [(1, None), (2, None)]])
def test_degenerate_rankings(spark, rows, data):
    df = spark.createDataFrame(data, "id int, v int")
    found = rows(d.add_ranks(df, {"p": ("percent_rank", "v"), "r": ("rank_desc", "v")}))
    assert [(r[2], r[3]) for r in found] == [(0.0, 1)] * len(data)


def test_cumulative_by_group(skewed, rows):
    w = Window.partitionBy("grp").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    expected = (
        skewed.filter("v is not null").groupBy("grp", F.col("v").alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(w))
        .withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    )
    found = d.cumulative(skewed, "v", ["grp"], per_range=40)
    columns = ["grp", "value", "n", "upto", "total"]
    assert rows(found, *columns) == rows(expected, *columns)


def test_a_null_group_is_a_group(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert rows(d.quantiles(df, "v", [0.5], ["g"])) == [("a", 5.0), (None, 1.5)]


def test_quantiles_equal_numpy(skewed):
    points = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    values = [r["x"] for r in skewed.select("x").collect()]
    found = d.cumulative(skewed, "x", per_range=100).agg(
        *[c.alias(n) for n, c in d.quantile_columns(points).items()]).first()
    assert np.allclose(list(found), np.quantile(values, points))


def test_describe_by_group(spark, rows):
    df = spark.createDataFrame(
        [("a", 1), ("a", 4), ("a", None), ("b", 2), ("c", None)], "g string, v int")
    found = {r["g"]: r for r in d.describe(df, "v", [0.5], ["g"]).collect()}
    assert tuple(found["a"])[1:] == (2, 2.5, pytest.approx(4.5 ** 0.5), 1.0, 4.0, 2.5)
    assert tuple(found["b"])[1:] == (1, 2.0, None, 2.0, 2.0, 2.0)
    assert tuple(found["c"])[1:] == (0, None, None, None, None, None)


def test_gini_and_lorenz(skewed):
    values = sorted(r["v"] for r in skewed.select("v").collect() if r["v"] is not None)
    n, x = len(values), np.array(values, dtype=float)
    expected = 2 * np.sum(np.arange(1, n + 1) * x) / (n * x.sum()) - (n + 1) / n
    counts = d.cumulative(skewed, "v", weigh=True, per_range=64)
    assert d.gini(counts).first()["gini"] == pytest.approx(expected)
    last = d.lorenz(counts).orderBy(F.desc("value")).first()
    assert (last["population_share"], last["value_share"]) == (1.0, 1.0)


def test_top_share_splits_a_tie(spark):
    df = spark.createDataFrame([(10,), (5,), (5,), (5,), (1,)], "v int")
    counts = d.cumulative(df, "v", weigh=True)
    found = d.top_share(counts, {"k": F.lit(3), "all": F.lit(99)}).collect()
    shares = {r["label"]: r["share"] for r in found}
    assert shares == {"k": pytest.approx(20 / 26), "all": pytest.approx(1.0)}


def test_cdf_ends_at_one(skewed):
    found = d.cdf(d.cumulative(skewed, "v", per_range=30)).orderBy("value").collect()
    shares = [r["cumulative_share"] for r in found]
    assert shares == sorted(shares)
    assert shares[-1] == 1.0


def test_number_rows_spreads_a_hot_group_of_copies(spark):
    """Two thirds of the rows are one group of equal values: places still run without gaps."""
    data = [("hot", "same", i) for i in range(2000)] + [("cold", str(i % 9), i) for i in range(999)]
    df = spark.createDataFrame(data, "g string, v string, id int").repartition(4)
    found = d.number_rows(df, ["v", "id"], ["g"], "place", per_range=100)
    hot = sorted((r["place"], r["id"]) for r in found.filter("g = 'hot'").collect())
    assert hot == [(i, i) for i in range(2000)]
    cold = [r for r in found.filter("g = 'cold'").collect()]
    assert [(r["v"], r["id"]) for r in sorted(cold, key=lambda r: r["place"])] == sorted(
        (str(i % 9), i) for i in range(999))


def test_ranges_hold_about_equal_numbers_of_values(spark):
    df = spark.range(20000).select((F.col("id") * F.col("id")).alias("v"))
    counts = d.histogram(df, "v")
    plan = d.running_totals(counts, per_range=1000)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text
    assert "CartesianProduct" not in text
    assert plan.agg(F.max("upto")).first()[0] == 20000
