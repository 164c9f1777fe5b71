"""Distinct counts and quantiles for exploration, from Spark's own mergeable sketches.

Off by default: the tables use exact figures.  A sketch is a few kilobytes per key whatever the key's
number of rows, slices of the facts are sketched apart and united later, and coarser grains come from the
sketches of finer ones without reading the facts again.

Stated errors: a distinct count of a HyperLogLog sketch with 2^lg_k registers has a relative standard
error of about 1.04 / sqrt(2^lg_k) (1.6 % at the default 12; small sets are exact); a quantile of a KLL
sketch of the default k lies within 1.33 % of the rank asked for, at 99 % confidence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.0133


def distinct_sketches(df: DataFrame, by: Sequence[str], of: str, lg_k: int = LG_K) -> DataFrame:
    """(by..., sketch) of the distinct values of a column; other types are sketched by their text."""
    plain = dict(df.dtypes)[of] in ("int", "bigint", "string", "binary")
    value = F.col(of) if plain else F.col(of).cast("string")
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def united_distinct(slices: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Sketches of several slices, or of a finer grain, as one per key."""
    return reduce(DataFrame.unionByName, slices).groupBy(*by).agg(
        F.hll_union_agg("sketch").alias("sketch")
    )


def distinct_counts(sketches: DataFrame, into: str) -> DataFrame:
    keys = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keys, F.hll_sketch_estimate("sketch").alias(into))


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., sketch) of the values of a column; keys without any value have none."""
    held = df.filter(F.col(value).isNotNull())
    return held.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def united_quantiles(slices: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, slices).groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch")
    )


def quantile_values(sketches: DataFrame, points: Sequence[float]) -> DataFrame:
    """One column pNN per point; values that occur, not interpolated."""
    keys = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{format(p * 100, 'g')}")
        for p in points
    ])


def distinct_check(df: DataFrame, key: str, of: str) -> DataFrame:
    """(keys, within): keys, and how many of them are estimated within three standard errors.

    The rows are sketched in two slices and united.
    """
    first = F.crc32(F.col(of).cast("string").cast("binary")) % 2 == 0
    parts = [distinct_sketches(df.filter(side), [key], of) for side in (first, ~first)]
    estimates = distinct_counts(united_distinct(parts, [key]), "estimate")
    exact = df.select(key, of).distinct().groupBy(key).agg(F.count(of).alias("exact"))
    off = F.abs(F.col("estimate") - F.col("exact"))
    close = off <= F.greatest(F.lit(1.0), 3 * DISTINCT_ERROR * F.col("exact"))
    return exact.join(estimates, key).agg(
        F.count("*").alias("keys"), F.count_if(close).alias("within")
    )


def quantile_check(df: DataFrame, key: str, value: str, points: Sequence[float]) -> DataFrame:
    """(key, n, within): points whose estimate lies within twice the stated rank error."""
    first = F.xxhash64(value) % 2 == 0
    parts = [quantile_sketches(df.filter(side), [key], value) for side in (first, ~first)]
    found = quantile_values(united_quantiles(parts, [key]), points)
    names = [c for c in found.columns if c not in (key, "n")]
    asked = F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("point"), F.col(name).alias("estimate"))
        for p, name in zip(points, names, strict=True)
    ])).alias("ask")
    asks = found.select(key, "n", asked).select(key, "n", "ask.point", "ask.estimate")
    ranks = df.filter(F.col(value).isNotNull()).select(key, value).join(asks, key).groupBy(
        key, "n", "point"
    ).agg(
        F.count_if(F.col(value) < F.col("estimate")).alias("below"),
        F.count_if(F.col(value) <= F.col("estimate")).alias("upto"),
    )
    slack = 2 * RANK_ERROR * F.col("n") + 1
    place = F.col("point") * F.col("n")
    close = (F.col("below") - slack <= place) & (place <= F.col("upto") + slack)
    return ranks.groupBy(key, "n").agg(F.count_if(close).alias("within"))
