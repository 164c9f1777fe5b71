"""Sharding by a hierarchical weighted hash tree, on DataFrame functions alone.

A shard is a leaf under a rack under a region.  A row descends the tree: on each level it draws a hash
for every child and takes the child with the smallest ``-ln(u) / weight``, so that children win in
proportion to their weights.  A draw depends on the row's key and the child's name alone.  When the
weight of a child changes, only draws against that child can turn out otherwise: rows move into or out
of subtrees whose weights change, and nowhere else.  A shard that comes in addition opens a region of
its own, so the only child whose weight changes is the new one, and it alone receives rows.

Defined results: a NULL key draws as the text ``null``; a NULL or empty text has no bytes, size 1 and
crc32 0; repeated rows land in one shard and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# hexadecimal digits of a hash that fit a double exactly, and those that name a slot range
DRAW_DIGITS = 13
RANGE_DIGITS = 3
# equal rows that are expanded at once
CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> list[Shard]:
    """A tree of equal weights; shards are numbered from 0 in the order of the tree."""
    return [
        Shard(region, rack, (region * racks + rack) * shards + shard)
        for region in range(regions) for rack in range(racks) for shard in range(shards)
    ]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    return [*tree, Shard(max(s.region for s in tree) + 1, 0, max(s.shard for s in tree) + 1, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.log(u) / F.lit(weight)


def _winner(key: Column, children: dict[int, float], name: str) -> Column:
    """The child that the key draws; equal draws go to the smaller number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [
        F.struct(_draw(key, f"{name}{child}", weight).alias("draw"), F.lit(child).alias("child"))
        for child, weight in sorted(children.items())
    ]
    return F.array_min(F.array(*draws))["child"]


def _by_parent(parent: Column, answers: dict[int, Column]) -> Column:
    chosen = F.lit(None).cast("int")
    for number, answer in sorted(answers.items(), reverse=True):
        chosen = F.when(parent == number, answer).otherwise(chosen)
    return chosen


def add_shard(
    df: DataFrame, key: str, tree: list[Shard],
    region: str = "region", rack: str = "rack", shard: str = "shard",
) -> DataFrame:
    """Add the region, rack and shard of each row, replacing columns of these names."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[tuple[int, int], dict[int, float]] = {}
    for s in tree:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        racks.setdefault(s.region, {})
        racks[s.region][s.rack] = racks[s.region].get(s.rack, 0.0) + s.weight
        shards.setdefault((s.region, s.rack), {})[s.shard] = s.weight
    df = df.withColumn(region, _winner(text, regions, "region "))
    df = df.withColumn(rack, _by_parent(F.col(region), {
        r: _winner(text, children, f"region {r} rack ") for r, children in racks.items()
    }))
    return df.withColumn(shard, _by_parent(F.col(region), {
        r: _by_parent(F.col(rack), {
            k: _winner(text, children, f"region {r} rack {k} shard ")
            for (of, k), children in shards.items() if of == r
        })
        for r in regions
    }))


def add_slots(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Within a shard, rows stand in the order of a hash over all their columns.  Equal rows are counted
    first, then rows are numbered inside ranges of that hash, and each range starts where the earlier
    ones end.  A hot row's count is cut into chunks, which are dealt to tasks before they become rows; so
    neither a shard nor a hot row is gathered in one task.
    """
    columns = df.columns
    values = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    counted = (
        df.groupBy(*columns).agg(F.count("*").alias("_n"))
        .withColumn("_order", F.md5(F.concat_ws("|", *values)))
        .withColumn("_range", F.substring("_order", 1, RANGE_DIGITS))
    )
    group = [shard, "_range"]
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*group).agg(F.sum("_n").alias("_size")).select(
        *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*group).orderBy("_order", *columns).rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = F.col("_first") + F.col("_n") - 1
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        counted.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(starts, group)
        .withColumn("_first", F.col("_start") + F.col("_earlier"))
        .select(*columns, last.alias("_last"), F.explode(
            F.sequence(F.col("_first"), last, F.lit(CHUNK_ROWS).cast("long"))
        ).alias("_from"))
        # with a number, as chunks are small until they are rows and would be put together by size
        .repartition(tasks, shard, "_from")
        .select(*columns, F.explode(
            F.sequence(F.col("_from"), F.least("_last", F.col("_from") + (CHUNK_ROWS - 1)))
        ).alias(slot))
    )


def shard_rows(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """One row per document: its key, size, checksum, shard, slot, and shard in the grown tree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = add_shard(placed, "doc_id", tree)
    placed = add_shard(placed, "doc_id", grown(tree), "grown_region", "grown_rack", "grown_shard")
    return add_slots(placed.drop("grown_region", "grown_rack"), "shard")
