"""Byte-level BPE by replaying the merges over a corpus of pieces at once.

The pattern cuts texts into pieces.  The distinct pieces of the words that are new in a block of texts are
laid out as one row of byte tokens, and an inverted index maps every mergeable token to the positions
whose token and right neighbour make it.  Merges are applied in the order of their ranks, each at all its
positions from left to right, and only the pairs with the touched neighbours are entered anew.  A piece
that is a token itself is that token.  A task remembers the words it has met (`word_ids`) and drops
them when its last row is done, so merges are replayed once per task and word.

Ids are kept as binary: unsigned 32-bit little-endian numbers, in order.

Defined results: a NULL or empty text has no ids and decodes to the empty text; special tokens in a
text are ordinary text; a piece of any length is merged whole; repeated rows encode alike; columns named
ids or decoded are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_name, handing_back, small_batches
from marquee.llm.word_ids import Coded, Numbers, Words, gathered, per_slice

# words that a task remembers from one block to the next, and characters of a block: both bound memory
# alone
REMEMBERED = 200_000
BLOCK_CHARS = 1 << 22
# positions whose pairs are looked up at a time, before the first merge; memory again
SLICE = 1 << 17
# above every id, so that two ids make one number
PAIR_BASE = 1 << 31


def _without_overlaps(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of neighbouring places in one row, every other one from the left."""
    if len(places) < 2 or not (after[places[:-1]] == places[1:]).any():
        return places
    chained = np.concatenate([[False], after[places[:-1]] == places[1:]])
    run_start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
    return places[(np.arange(len(places)) - run_start) % 2 == 0]


class Vocabulary:
    """The tokens of a rank file and their ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in
                        (line.split() for line in file if line.strip())}
        tokens = {number: token for token, number in self.ids.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.pairs, self.makes = self._mergeable()
        # the bytes of all tokens one after the other, to decode from
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        self.sizes[list(tokens)] = [len(token) for token in tokens.values()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def _mergeable(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, in order, and what they make."""
        pairs, makes = array("q"), array("q")
        for token, number in self.ids.items():
            for at in range(1, len(token)):
                left, right = self.ids.get(token[:at]), self.ids.get(token[at:])
                if left is not None and right is not None:
                    pairs.append(left * PAIR_BASE + right)
                    makes.append(number)
        order = np.argsort(np.array(pairs, np.int64))
        return np.array(pairs, np.int64)[order], np.array(makes, np.int64)[order]

    def made_by(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair of tokens makes, or -1."""
        pairs = left.astype(np.int64) * PAIR_BASE + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.makes[at], -1)

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(pieces) else 0
        if not total:
            return [[] for _ in pieces]
        # tokens and positions take 32 bits unless there are too many of them
        kind = np.int32 if total < PAIR_BASE else np.int64
        token = np.array(self.byte_ids, kind)[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, total + 1, dtype=kind)  # position of the right neighbour, -1 at the end of a piece
        before = np.arange(-1, total - 1, dtype=kind)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        makes = np.full(total, -1, kind)  # what a token and its right neighbour make
        index: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        out_of_order: list[np.ndarray] = []

        def enter(places: np.ndarray, rank: int) -> None:
            made = self.made_by(token[places], token[after[places]])
            makes[places] = made
            real = made >= 0
            made, places = made[real], places[real]
            if not len(made):
                return
            if made.min() < rank:
                out_of_order.append(places[made < rank])
            order = np.argsort(made, kind="stable")
            made, places = made[order], places[order]
            borders = [0, *(np.flatnonzero(made[1:] != made[:-1]) + 1).tolist(), len(made)]
            for begin, end in zip(borders, borders[1:], strict=False):
                number = int(made[begin])
                if number not in index:
                    index[number] = []
                    heapq.heappush(ranks, number)
                index[number].append(places[begin:end])

        for begin in range(0, total, SLICE):
            inner = np.flatnonzero(after[begin:begin + SLICE] >= 0).astype(kind) + kind(begin)
            if len(inner):
                enter(inner, -1)
        while ranks:
            rank = heapq.heappop(ranks)
            places = np.sort(np.concatenate(index.pop(rank)))
            places = places[makes[places] == rank]
            places = places[np.diff(places, prepend=-1) > 0]
            places = _without_overlaps(places, after)
            if not len(places):
                continue
            right = after[places]
            token[places], token[right] = rank, -1
            makes[places], makes[right] = -1, -1
            further = after[right]
            after[places] = further
            before[further[further >= 0]] = places[further >= 0]
            left = before[places]
            touched = np.concatenate([left[left >= 0], places[further >= 0]])
            if len(touched):
                enter(touched, rank)
        late = np.concatenate(out_of_order) if out_of_order else np.zeros(0, np.int64)
        again = set(np.searchsorted(ends, late, "right").tolist())
        after = before = makes = None
        alive = token >= 0
        ids = token[alive].tolist()
        upto = np.cumsum(alive)
        stops = np.where(ends > 0, upto[ends - 1], 0).tolist()
        begins = [0, *stops[:-1]]
        return [
            self.one_by_one(piece) if i in again else ids[s:e]
            for i, (piece, s, e) in enumerate(zip(pieces, begins, stops, strict=True))
        ]

    def one_by_one(self, piece: bytes) -> list[int]:
        """A single piece, always merging the leftmost pair of lowest rank.

        Only for vocabularies in which a merge can make a pair of lower rank than its own; there the
        order over all pieces is not the order within each piece.
        """
        ids = [self.byte_ids[b] for b in piece]
        while len(ids) > 1:
            found = self.made_by(np.array(ids[:-1]), np.array(ids[1:])).tolist()
            best = min((f for f in found if f >= 0), default=-1)
            if best < 0:
                break
            at = found.index(best)
            ids[at:at + 2] = [best]
        return ids

    def __call__(self, words: list[str]) -> Coded:
        """Ids of words: their distinct pieces are encoded all together."""
        numbers = Numbers()
        find, number = self.pattern.findall, numbers.__getitem__
        found = [list(map(number, find(word))) for word in words]
        parts = np.fromiter(map(len, found), np.int64, len(found))
        used = np.fromiter(chain.from_iterable(found), np.int64, int(parts.sum()))
        del found
        pieces = [piece.encode() for piece in numbers]
        whole = [self.ids.get(piece) for piece in pieces]
        rest = iter(self.replay([p for p, n in zip(pieces, whole, strict=True) if n is None]))
        coded = [next(rest) if n is None else (n,) for n in whole]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int64, int(sizes.sum()))
        lengths = per_slice(sizes[used], parts)
        return (gathered(flat, (np.cumsum(sizes) - sizes)[used], sizes[used]),
                np.cumsum(lengths) - lengths, lengths)

    def decode(self, ids: bytes | None) -> bytes:
        numbers = np.frombuffer(ids or b"", "<u4")
        return gathered(self.bytes, self.starts[numbers], self.sizes[numbers]).tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """A worker reads the file once; what stays is of the file's size."""
    return Vocabulary(path, pattern)


def encode(words: Words, texts: list[str | None]) -> Iterator[bytes]:
    """The ids of each text, read in blocks."""
    at = 0
    while at < len(texts):
        block: list[str] = []
        chars = 0
        while at + len(block) < len(texts) and (not block or chars < BLOCK_CHARS):
            block.append(texts[at + len(block)] or "")
            chars += len(block[-1])
        numbers, sizes = words.read(block)
        ids = words.ids(0, numbers).astype("<u4")
        lengths = per_slice(words.lengths[0][numbers], sizes)
        ends = np.cumsum(lengths)
        yield from (ids[e - n:e].tobytes() for n, e in zip(lengths.tolist(), ends.tolist(), strict=True))
        at += len(block)


def add_ids(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of a text; ``path`` is the rank file, present on every executor."""
    small_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words([vocabulary(path, pattern)], remembered=REMEMBERED)
        with handing_back():
            for texts in batches:
                with handing_back():
                    yield pd.Series(list(encode(words, texts.tolist())), dtype=object)
            words.forget()

    return df.withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))


def add_decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids",
                decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for."""
    @F.pandas_udf("binary")
    def text_of(column: pd.Series) -> pd.Series:
        words = vocabulary(path, pattern)
        return pd.Series([words.decode(x) for x in column])

    return df.withColumn(decoded, text_of(F.col(ids)))


def coded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ids and, decoded from them, the bytes of the text, both by one worker of a task.

    As `add_ids` and `add_decoded` one after the other, for which Spark would hold two workers.
    """
    small_batches(docs.sparkSession)
    name = free_name(docs, "_coded")

    @F.pandas_udf("struct<ids: binary, decoded: binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = vocabulary(path, pattern)
        words = Words([known], remembered=REMEMBERED)
        with handing_back():
            for texts in batches:
                with handing_back():
                    ids = list(encode(words, texts.tolist()))
                    yield pd.DataFrame({"ids": ids, "decoded": [known.decode(x) for x in ids]}, dtype=object)
                    del ids
            words.forget()

    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    return docs.withColumn(name, both(F.coalesce(F.col("text"), F.lit("")))).select(*kept, f"{name}.*")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return coded(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
