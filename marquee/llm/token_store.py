"""Token ids in binary files, compressed by a Re-Pair grammar per shard.

Documents are brought into the order of doc_id by ranges.  A task encodes its range, one document after the
other, each closed by an end id, and cuts the ids into shards of whole documents.  In a shard the frequent
pairs of neighbouring symbols are replaced by nonterminals, again and again, until no round pays.  All pairs
of a round have a symbol of their own side: no symbol is the left half of one and the right half of another,
so their places never overlap (of a pair of twice the same symbol every other place counts).

A shard is one binary value: the rules, the expansion length of every nonterminal, the symbols left, and the
number of ids before every `MARK`-th symbol, so `sliced` finds and expands only what it needs.  Spark writes
shards as rows of a Parquet folder with their documents beside them, so files appear whole or not at all
and may lie in any store.

Defined results: a NULL or empty text has the end id alone; rows without doc_id come first; rows of one
doc_id are in the order of a hash of their text, and repeated rows are spread over tasks; a text of any
length is kept whole, if need be as a shard of its own; strings of special tokens in a text become these
tokens, as the library does by itself; further columns are ignored; an empty table makes no shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from marquee.llm.common import keep, small_batches
from marquee.llm.word_ids import Words, byte_level, gathered

END_ID = 2
SHARD_IDS = 1 << 20
BLOCK_CHARS = 1 << 20
# a pair is frequent from so many places on; pairs tried and rounds made at most; share of symbols that a
# round must save.  They shape the size of files and the time to make them, never what is read.
FREQUENT, PAIRS_A_ROUND, ROUNDS, PAYS = 4, 4000, 8, 0.01
# a symbol takes two bytes, so rules end where the symbols reach this, if the vocabulary is below it
NARROW = 1 << 16

MAGIC = b"RPG1"
HEADER = struct.Struct("<4sBIIIQ")  # magic, bytes of a symbol, first nonterminal, rules, symbols, ids
MARK = 1024

SHARDS = ("part int, shard long, start_in_part long, n_ids long, doc_ids array<long>,"
          " n_tokens array<long>, data binary")


def _frequent(ranked: Sequence[tuple[int, int]]) -> list[int]:
    """Of pairs in the order of their counts, those whose places cannot overlap."""
    sides: dict[int, int] = {}
    chosen = []
    for i, (left, right) in enumerate(ranked):
        if left == right:
            if left not in sides:
                sides[left] = 3
                chosen.append(i)
        elif sides.get(left, 1) == 1 and sides.get(right, 2) == 2:
            sides[left], sides[right] = 1, 2
            chosen.append(i)
    return chosen


def _round(symbols: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace frequent pairs once: (symbols, pairs replaced as left * first + right)."""
    # below NARROW symbols a pair fits into 32 bits, which sort faster
    pairs = symbols[:-1] * symbols.dtype.type(first) + symbols[1:]
    ordered = np.sort(pairs)
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(begins, len(ordered)))
    often = np.flatnonzero(counts >= FREQUENT)
    often = often[np.argsort(-counts[often], kind="stable")][:PAIRS_A_ROUND]
    if first <= NARROW:
        often = often[:NARROW - first]
    keys = ordered[begins[often]]
    ranked = list(zip((keys // first).tolist(), (keys % first).tolist(), strict=True))
    chosen = np.sort(keys[_frequent(ranked)])
    if not len(chosen):
        return symbols, chosen
    left, right = np.zeros(first, bool), np.zeros(first, bool)
    left[chosen // first] = right[chosen % first] = True
    at = np.flatnonzero(left[symbols[:-1]] & right[symbols[1:]])
    rule = np.searchsorted(chosen, pairs[at])
    rule[rule == len(chosen)] = 0
    hit = chosen[rule] == pairs[at]
    at, rule = at[hit], rule[hit]
    # only twice the same symbol can stand at neighbouring places: every other one counts
    chained = np.concatenate([[False], np.diff(at) == 1])
    run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    apart = (np.arange(len(at)) - run) % 2 == 0
    at, rule = at[apart], rule[apart]
    out = symbols.copy()
    out[at] = first + rule
    stays = np.ones(len(out), bool)
    stays[at + 1] = False
    return out[stays], chosen


def packed(ids: np.ndarray, vocabulary: int) -> bytes:
    """A shard's binary value; all ids are below ``vocabulary``."""
    symbols, first = np.asarray(ids, np.uint32 if vocabulary < NARROW else np.int64), vocabulary
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        fewer, chosen = _round(symbols, first)
        if not len(chosen):
            break
        lefts.append(chosen.astype(np.int64) // first)
        rights.append(chosen.astype(np.int64) % first)
        paid = len(symbols) - len(fewer) >= PAYS * len(symbols)
        symbols, first = fewer, first + len(chosen)
        if not paid:
            break
    left, right = np.concatenate(lefts), np.concatenate(rights)
    sizes = _sizes(left, right, vocabulary)
    wide = "<u4" if first > NARROW else "<u2"
    lengths = sizes[symbols]
    marks = (np.cumsum(lengths) - lengths)[::MARK]
    head = HEADER.pack(MAGIC, int(wide[-1]), vocabulary, len(left), len(symbols), len(ids))
    return b"".join([
        head, left.astype("<u4").tobytes(), right.astype("<u4").tobytes(),
        sizes[vocabulary:].astype("<u4").tobytes(), marks.astype("<u8").tobytes(),
        symbols.astype(wide).tobytes(),
    ])


def _sizes(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each symbol stands for; rules only name earlier symbols."""
    sizes = [1] * vocabulary
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        sizes.append(sizes[a] + sizes[b])
    return np.array(sizes, np.int64)


class Shard:
    """A binary value opened for reading; parts are views, nothing is expanded yet."""

    def __init__(self, data: bytes):
        magic, wide, self.first, rules, symbols, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.left, self.right, self.sizes = (part("<u4", rules) for _ in range(3))
        self.marks = part("<u8", -(-symbols // MARK))
        self.symbols = part(f"<u{wide}", symbols)

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        while True:
            rule = symbols >= self.first
            if not rule.any():
                return symbols
            out = np.repeat(symbols, 1 + rule)
            at = np.cumsum(1 + rule)[rule] - 2
            out[at] = self.left[symbols[rule] - self.first]
            out[at + 1] = self.right[symbols[rule] - self.first]
            symbols = out

    def all_ids(self) -> np.ndarray:
        """Every symbol is looked up in the list of all expansions."""
        rules = self.expanded(np.arange(self.first, self.first + len(self.sizes)))
        sizes = np.concatenate([np.ones(self.first, np.int64), self.sizes.astype(np.int64)])
        flat = np.concatenate([np.arange(self.first), rules])
        return gathered(flat, (np.cumsum(sizes) - sizes)[self.symbols], sizes[self.symbols])

    def sliced(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop, expanding only the symbols that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int64)
        low = int(np.searchsorted(self.marks, start, "right") - 1)
        high = int(np.searchsorted(self.marks, stop, "left"))
        symbols = self.symbols[low * MARK:high * MARK].astype(np.int64)
        rule = symbols >= self.first
        lengths = np.ones(len(symbols), np.int64)
        lengths[rule] = self.sizes[symbols[rule] - self.first]
        ends = int(self.marks[low]) + np.cumsum(lengths)
        one = int(np.searchsorted(ends, start, "right"))
        two = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[one] - lengths[one])
        return self.expanded(symbols[one:two])[start - before:stop - before]


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _coded(batches: Iterator[pa.RecordBatch], words: Words, end_id: int) -> Iterator[tuple]:
    """(doc_id, ids) of every row."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(keys):
            block: list[str] = []
            chars = 0
            while at + len(block) < len(keys) and (not block or chars < BLOCK_CHARS):
                block.append(texts[at + len(block)].as_py() or "")
                chars += len(block[-1])
            numbers, sizes = words.read(block)
            stops = np.cumsum(sizes)
            for i, (stop, size) in enumerate(zip(stops, sizes, strict=True)):
                ids = words.ids(0, numbers[stop - size:stop])
                yield keys[at + i], np.append(ids, end_id)
            at += len(block)


def shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           end_id: int = END_ID) -> DataFrame:
    """Encode, order and compress; ``path`` is the tokenizer file, present on every executor."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "*", F.xxhash64("text").alias("told"), (F.monotonically_increasing_id() % 1024).alias("salt")
    )

    wanted = _arrow(SHARDS)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(path)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pydict({
                "part": [part], "shard": [number], "start_in_part": [before], "n_ids": [len(ids)],
                "doc_ids": [keys], "n_tokens": [[len(x) for x in held]],
                "data": [packed(ids, len(coder.entries))],
            }, wanted)

        size = 0
        for doc_id, ids in _coded(batches, Words([coder]), end_id):
            if held and size + len(ids) > SHARD_IDS:
                yield shard()
                number, before, size, keys, held = number + 1, before + size, 0, [], []
            keys.append(doc_id)
            held.append(ids)
            size += len(ids)
        if held:
            yield shard()

    return (
        rows.repartitionByRange("doc_id", "told", "salt").sortWithinPartitions("doc_id", "told")
        .select("doc_id", "text").mapInArrow(made, SHARDS)
    )


def write(docs: DataFrame, path: str, folder: str, **options) -> None:
    """Write the files of a table's token ids to a folder."""
    shards(docs, path, **options).write.parquet(folder)


DOCUMENTS = "part int, doc_id long, start_in_part long, n_tokens long, ids binary"


def documents(files: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """The documents of files: (part, doc_id, start_in_part, n_tokens, ids as little-endian u32).

    With ``wanted`` only the shards that hold these ids are opened, and only their ids are expanded.
    """
    if wanted is not None:
        files = files.filter(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)).cast("array<long>")))
    chosen = None if wanted is None else set(wanted)
    schema = _arrow(DOCUMENTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                shard, lengths = Shard(row["data"].as_py()), row["n_tokens"].as_py()
                keys, start = row["doc_ids"].as_py(), row["start_in_part"].as_py()
                stops = np.cumsum(lengths).tolist()
                spans = [(k, e - n, e) for k, n, e in zip(keys, lengths, stops, strict=True)
                         if chosen is None or k in chosen]
                whole = shard.all_ids() if chosen is None else None
                ids = [(shard.sliced(s, e) if whole is None else whole[s:e]).astype("<u4").tobytes()
                       for _, s, e in spans]
                yield pa.RecordBatch.from_pydict({
                    "part": [row["part"].as_py()] * len(spans), "doc_id": [k for k, _, _ in spans],
                    "start_in_part": [start + s for _, s, _ in spans],
                    "n_tokens": [e - s for _, s, e in spans], "ids": ids,
                }, schema)

    return files.select("part", "start_in_part", "doc_ids", "n_tokens", "data").mapInArrow(
        read, DOCUMENTS
    )


def part_starts(files: DataFrame) -> DataFrame:
    """(part, start): ids before each range of documents.  One row a range is put in order."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start")
    )


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    # the ids are summed up before the join, so that none are shuffled
    told = documents(files).select(
        "part", "doc_id", "start_in_part", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return told.join(part_starts(files), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def stored(docs: DataFrame, path: str) -> DataFrame:
    """The files of a table in the shared folder, read back."""
    return keep(shards(docs, path), "token files")
