"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has a bit set where more than half of the text's shingle hashes have it set.  To find
fingerprints that differ in few bits, the 64 bits are cut into 32 segments of two, and a fingerprint
becomes the point of its 32 bit counts (0, 1 or 2).  The Manhattan distance of two points never exceeds
the number of differing bits, so pairs farther apart than the limit are ruled out by it, and the rest
are verified on the bits.

The range join on points runs on a grid: each point has two cells, one of each half of the bits.  So that
cells are small, their axes are the counts of 32 segments in a ring, where every bit lies in two segments
of two neighbouring bits.  Two fingerprints that differ in three bits or fewer differ in at most one bit
of one of the halves.  There, either their cells are equal, or one cell lies one bit up, that is one
count more in the two segments of this bit, so it is enough that each point also knocks at the cells
one bit up.  Every join is an equality join on (half, cell), and no pair within the limit is missed.
Unrelated fingerprints meet in a cell about as rarely as equal 32 bits do.

Texts of equal fingerprints are one point, so copies are never paired with one another.  The points
that lie within the limit of a centre are at most a few ten thousand, however many rows there are.

Defined results: NULL, empty and blank texts have fingerprint 0 and link like any other; a text of one
or two words has one shingle, the whole sequence; rows without doc_id get a component like others but
never name it (NULL if none of the component has an id); repeated rows share a component; very long
texts are read whole, their hashes counted in chunks; an empty table gives no rows; columns of the input
beside the two that are named play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, free_name, handing_back, keep, small_batches

SEED = 42
SHINGLE_WORDS = 3
LIMIT = 3
# hashes whose bits are counted at once: bounds memory on very long texts
CHUNK = 1 << 15

HALF_BITS = 32
HALF_MASK = 0xFFFFFFFF
LOW_BITS = 0x5555555555555555
# shifts and masks that move bit i of a half to bit 2i
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
          (2, 0x3333333333333333), (1, LOW_BITS)]


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = [
            digest(joined[s:e], SEED)
            for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)
        ]
        rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of a text column as a signed long."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with handing_back():
            for texts in batches:
                found = np.fromiter((fingerprint(t) for t in texts), "<u8", len(texts))
                yield pd.Series(found.view(np.int64))

    return df.withColumn(name, prints(F.col(text).cast("binary")))


def _bits(number: int) -> Column:
    """A constant of 64 bits as Spark's signed long."""
    return F.lit(number - (1 << 64) if number >= 1 << 63 else number).cast("long")


def _spread(half: Column) -> Column:
    """The 32 bits of a half with a free place above each."""
    for shift, mask in SPREAD:
        half = half.bitwiseOR(F.shiftleft(half, shift)).bitwiseAND(_bits(mask))
    return half


def _cell(half: Column) -> Column:
    """The bit counts of a half's 32 segments in a ring, packed two bits each."""
    turned = F.shiftright(half, 1).bitwiseOR(F.shiftleft(half.bitwiseAND(_bits(1)), HALF_BITS - 1))
    own, beside = _spread(half), _spread(turned)
    return own.bitwiseXOR(beside).bitwiseOR(F.shiftleft(own.bitwiseAND(beside), 1))


def _steps(print_: Column) -> Column:
    """The bit counts in unary (0, 1, 11), so that differing bits are the Manhattan distance."""
    shifted = F.shiftrightunsigned(print_, 1)
    some = print_.bitwiseOR(shifted).bitwiseAND(_bits(LOW_BITS))
    both = print_.bitwiseAND(shifted).bitwiseAND(_bits(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, column ``print``, that differ in ``limit`` bits or fewer.

    The grid serves limits up to 3.  A pair may be found in both halves and then appears twice.
    """
    if not 0 <= limit <= 3:
        raise ValueError("the grid serves limits from 0 to 3")
    halves = points.select(
        "print", F.posexplode(F.array(
            F.col("print").bitwiseAND(_bits(HALF_MASK)), F.shiftrightunsigned("print", HALF_BITS)
        )).alias("half", "bits"),
    )
    one_up = F.array(*[
        F.when(F.col("bits").bitwiseAND(_bits(1 << i)) == 0, F.col("bits").bitwiseOR(_bits(1 << i)))
        for i in range(HALF_BITS)
    ])
    knocks = halves.select(
        "half", F.col("print").alias("a"), "bits",
        F.explode(F.array_compact(F.concat(F.array("bits"), one_up))).alias("at"),
    ).select("half", "a", (F.col("at") != F.col("bits")).alias("up"), _cell(F.col("at")).alias("cell"))
    homes = halves.select("half", _cell(F.col("bits")).alias("cell"), F.col("print").alias("b"))
    a, b = F.col("a"), F.col("b")
    return (
        # sorted on both sides: Spark takes the knocks for as small as the points and would broadcast them
        knocks.hint("merge").join(homes, ["half", "cell"])
        # points of one cell would meet twice
        .filter(F.col("up") | (a < b))
        .filter((a != b) & (_distance(_steps(a), _steps(b)) <= limit) & (_distance(a, b) <= limit))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    limit: int = LIMIT) -> DataFrame:
    """(key, fingerprint, component_id) of every row."""
    printed = keep(
        add_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")),
                        "text", "print").select("doc_id", "print"),
        "fingerprints",
    )
    smallest = keep(printed.groupBy("print").agg(F.min("doc_id").alias("first")), "points")
    groups = components(links(smallest, limit)).withColumnRenamed("node", "print")
    members = smallest.join(groups, "print", "left").withColumn(
        "component", F.coalesce("component", "print")
    )
    named = members.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = members.join(named, "component").select("print", "component_id")
    # a file of narrow rows is a small part of what they take in memory, so neither side is broadcast
    return printed.hint("merge").join(of_print, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def without_near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One document of each component, the one with its smallest doc_id; repeats of it go too.

    Of rows that share this id the one with the smallest other columns stays.  A component in which no
    row has an id keeps its smallest row in the same order.
    """
    columns = docs.columns
    marked, digest = free_name(docs, "_print"), free_name(docs, "_digest")
    # the digest stands for the row, so that only narrow rows decide who stays
    whole_row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    told = docs.withColumn(digest, whole_row)
    narrow = keep(
        add_fingerprint(told, "text", marked).select(
            F.col(marked).alias("print"), "doc_id", F.col(digest).alias("digest")
        ),
        "fingerprints",
    )
    groups = components(links(narrow.select("print").distinct(), limit)).withColumnRenamed(
        "node", "print"
    )
    stays = (
        narrow.join(groups, "print", "left")
        .groupBy(F.coalesce("component", "print").alias("component"))
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("row"))
        .select(F.col("row.digest").alias(digest))
    )
    return told.join(stays, digest, "left_semi").dropDuplicates([digest]).select(*columns)
