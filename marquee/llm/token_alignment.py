"""Alignment of two tokenizers by a galloping intersection of their token ends.

Both tokenizers read a space and the text, and every token ends at a byte of that.  Of the two sorted lists
of ends the shorter one drives: each of its ends gallops through the other list, in steps of 1, 2, 4 ... from
the first token of its word until it is passed, then halves the last step.  Ends in both lists cut the
document into groups; the ranks of a common end in both lists, less those of the end before, are the tokens of
the group on either side.  All ends of a block of documents search together in numpy.

Tokens of a group are linked, each of one side to each of the other.  Links are counted by pairs of ids: a
group's ids are counted on each side first, so a group of many equal tokens is a few products.  A document's
pairs are written once with their numbers, Spark counts documents by pair over the corpus, takes the highest
count of every first id, and brings both back to the documents: as a broadcast while there are no more than
`BROADCAST_PAIRS` pairs, counted before, else by a join on the pair.

Defined results: NULL and empty texts, and texts whose tokens do not spell them (they hold the piece
vocabulary's space mark), have zeros and the empty groups text; strings of special tokens are ordinary text;
texts of any length are aligned whole, and the pairs of a document are spread over rows if there are very
many; repeated rows are documents of their own; rows without doc_id keep their NULL; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from marquee.llm.common import keep, small_batches
from marquee.llm.word_ids import Words, byte_level, gathered, per_slice, piece_model

BLOCK_CHARS = 1 << 19
PAIRS_A_ROW = 1 << 20
# products of the ids of both sides that are made at once
PRODUCTS = 1 << 20
# about 40 bytes each, once in the driver and once in an executor
BROADCAST_PAIRS = 1_000_000
DIGITS = 5

DOCS = ("row long, doc_id long, first boolean, n_a long, n_b long, n_groups long, n_links long,"
        " groups_sha256 string, pairs array<int>, times array<long>")


def gallop(keys: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each key the first place at or after its begin whose end is not below it.

    The last end is at or above every key.
    """
    low, high = begins.copy(), begins.copy()
    active = np.flatnonzero(ends[begins] < keys)
    step = 1
    while len(active):
        probe = np.minimum(low[active] + step, len(ends) - 1)
        below = ends[probe] < keys[active]
        high[active] = probe
        active, probe = active[below], probe[below]
        low[active] = probe
        step *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) // 2
        below = ends[middle] < keys[active]
        low[active[below]] = middle[below]
        high[active[~below]] = middle[~below]
        active = active[high[active] - low[active] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray, a_begins: np.ndarray, b_begins: np.ndarray,
                a_drives: np.ndarray, b_drives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of common ends in both lists.

    ``a_begins`` is for each end of b a place in a to gallop from, and the other way round; ``a_drives``
    tells which ends of a search in b, ``b_drives`` which of b in a.
    """
    from_a, from_b = np.flatnonzero(a_drives), np.flatnonzero(b_drives)
    in_b = gallop(a[from_a], b, b_begins[from_a])
    in_a = gallop(b[from_b], a, a_begins[from_b])
    hit_a, hit_b = b[in_b] == a[from_a], a[in_a] == b[from_b]
    places_a = np.concatenate([from_a[hit_a], in_a[hit_b]])
    places_b = np.concatenate([in_b[hit_a], from_b[hit_b]])
    order = np.argsort(places_a, kind="stable")
    return places_a[order], places_b[order]


def _counted(groups: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Distinct ids of each group: (group, id, how often)."""
    keys, counts = np.unique(groups * width + ids, return_counts=True)
    return keys // width, keys % width, counts


def _links(group_doc: np.ndarray, a: tuple, b: tuple, b_width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, pair, times), distinct pairs of each slice of the products of all groups."""
    (a_group, a_id, a_times), (b_group, b_id, b_times) = a, b
    size = np.bincount(b_group, minlength=len(group_doc))
    begin = np.cumsum(size) - size
    made = np.cumsum(size[a_group])
    at = done = 0
    while at < len(a_id):
        # at least one id; the products of one id are no more than the second vocabulary
        stop = max(at + 1, int(np.searchsorted(made, done + PRODUCTS, "right")))
        counts = size[a_group[at:stop]]
        left = np.repeat(np.arange(at, stop), counts)
        right = gathered(np.arange(len(b_id)), begin[a_group[at:stop]], counts)
        pair = a_id[left] * b_width + b_id[right]
        yield (*_summed(group_doc[a_group[left]], pair, a_times[left] * b_times[right]),)
        at, done = stop, int(made[stop - 1])


def _summed(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Times by document and pair."""
    keys = docs * (1 << 32) + pairs
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return (keys[first] >> 32, keys[first] & 0xFFFFFFFF,
            np.add.reduceat(times[order], first) if len(keys) else times)


class Aligner:
    """Aligns blocks of texts; one for each task, whose words it remembers."""

    def __init__(self, tokenizer: str, pieces: str):
        self.coders = [byte_level(tokenizer, special_as_text=True), piece_model(pieces)]
        self.words = Words(self.coders, led=True)
        self.b_width = len(self.coders[1].entries)
        largest = max(len(c.entries) for c in self.coders)
        if largest > 10 ** DIGITS or largest * self.b_width >= 1 << 31:
            raise ValueError("the vocabularies are too large for pairs of 31 bits")
        digits = np.array([b"%d" % i for i in range(largest)], f"S{DIGITS}")
        self.digits = digits.view(np.uint8).reshape(largest, DIGITS)
        self.spells = np.zeros(0, bool)
        self.forgotten = self.words.forgotten

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and sizes of texts; notes of new words whether both tokenizers spell them."""
        numbers, sizes = self.words.read(texts)
        if self.words.forgotten != self.forgotten:
            self.forgotten, self.spells = self.words.forgotten, np.zeros(0, bool)
        known = len(self.spells)
        told = [key.encode() for key in self.words.spelled(list(islice(self.words.numbers, known, None)))]
        new = np.ones(len(told), bool)
        for c, coder in enumerate(self.coders):
            lengths = self.words.lengths[c][known:]
            entries = map(coder.entries.__getitem__,
                          gathered(self.words.flat[c], self.words.starts[c][known:], lengths).tolist())
            new &= np.fromiter(
                (b"".join(islice(entries, n)) == word
                 for word, n in zip(told, lengths.tolist(), strict=True)), bool, len(told),
            )
        self.spells = np.concatenate([self.spells, new])
        return numbers, sizes

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, ...]]:
        """Per text: counts and the digest of its groups; and (text, pair, times) of all links."""
        numbers, sizes = self._read(texts)
        doc_of_word = np.repeat(np.arange(len(texts)), sizes)
        good = np.fromiter(map(bool, texts), bool, len(texts))
        good &= per_slice(~self.spells[numbers], sizes) == 0
        kept = good[doc_of_word]
        numbers, doc_of_word = numbers[kept], doc_of_word[kept]
        ids, ends, words, docs = [], [], [], []
        for c, coder in enumerate(self.coders):
            tokens = self.words.lengths[c][numbers]
            ids.append(self.words.ids(c, numbers))
            ends.append(np.cumsum(coder.sizes[ids[c]]))
            words.append((np.cumsum(tokens) - tokens, np.repeat(np.arange(len(numbers)), tokens)))
            docs.append(doc_of_word[words[c][1]])
        n_a, n_b = (np.bincount(d, minlength=len(texts)) for d in docs)
        a_leads = n_a <= n_b
        at_a, at_b = common_ends(
            ends[0], ends[1], words[0][0][words[1][1]], words[1][0][words[0][1]],
            a_leads[docs[0]], ~a_leads[docs[1]],
        )
        in_a, in_b = (np.diff(at, prepend=-1) for at in (at_a, at_b))
        group_doc = docs[0][at_a]
        counts = {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=len(texts)),
        }
        counts["n_links"] = per_slice(in_a * in_b, counts["n_groups"])
        group_a, group_b = (np.repeat(np.arange(len(at_a)), n) for n in (in_a, in_b))
        parts = list(_links(
            group_doc, _counted(group_a, ids[0], len(self.coders[0].entries)),
            _counted(group_b, ids[1], self.b_width), self.b_width,
        ))
        none = np.zeros(0, np.int64)
        whole = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none,) * 3
        links = _summed(*whole)
        digests = self._digests(ids, in_a, in_b, group_a, group_b, at_a, at_b, counts)
        return counts, digests, links

    def _digests(self, ids, in_a, in_b, group_a, group_b, at_a, at_b, counts) -> list[str]:
        """The digest of each text's groups, written one after the other."""
        total = len(ids[0]) + len(ids[1])
        written = np.zeros((total, DIGITS + 1), np.uint8)
        before_a, before_b = at_a + 1 - in_a, at_b + 1 - in_b
        place_a = np.arange(len(ids[0])) + before_b[group_a]
        place_b = np.arange(len(ids[1])) + (at_a + 1)[group_b]
        for place, own in ((place_a, ids[0]), (place_b, ids[1])):
            written[place, :DIGITS] = self.digits[own]
            written[place, DIGITS] = ord(",")
        written[place_a[at_a], DIGITS] = ord("|")
        written[place_b[at_b], DIGITS] = ord(";")
        doc_ends = np.cumsum(counts["n_groups"])[counts["n_groups"] > 0] - 1
        written[place_b[at_b[doc_ends]], DIGITS] = 0
        shown = written != 0
        lengths = per_slice(shown.sum(axis=1), counts["n_a"] + counts["n_b"])
        told = memoryview(written[shown].tobytes())
        out, at = [], 0
        for n in lengths.tolist():
            out.append(hashlib.sha256(told[at:at + n]).hexdigest() if n else "")
            at += n
        return out


def _rows(keys: list, row: int, found: tuple) -> dict[str, list]:
    """Columns of `DOCS`; pairs that are too many for one row are put on further ones."""
    counts, digests, (docs, pairs, times) = found
    out: dict[str, list] = {field.split()[0]: [] for field in DOCS.split(", ")}
    stops = np.searchsorted(docs, np.arange(len(keys)), "right").tolist()
    begin = 0
    numbers = {name: values.tolist() for name, values in counts.items()}
    for i, (key, stop) in enumerate(zip(keys, stops, strict=True)):
        for at in range(begin, max(stop, begin + 1), PAIRS_A_ROW):
            upto = min(stop, at + PAIRS_A_ROW)
            out["row"].append(row + i)
            out["doc_id"].append(key)
            out["first"].append(at == begin)
            for name, values in numbers.items():
                out[name].append(values[i])
            out["groups_sha256"].append(digests[i])
            out["pairs"].append(pairs[at:upto].astype(np.int32))
            out["times"].append(times[at:upto])
        begin = stop
    return out


def alignments(docs: DataFrame, tokenizer: str, pieces: str, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """`DOCS` of every document: counts, digest and linked pairs (first id * pieces + second id).

    ``row`` tells the documents apart; it follows from the task, so write the frame before it is joined.
    """
    small_batches(docs.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(DOCS))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, pieces)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                block: list[str] = []
                chars = 0
                while at + len(block) < len(keys) and (not block or chars < BLOCK_CHARS):
                    block.append(texts[at + len(block)].as_py() or "")
                    chars += len(block[-1])
                own = keys[at:at + len(block)]
                yield pa.RecordBatch.from_pydict(_rows(own, row, aligner.align(block)), schema)
                at += len(block)
                row += len(block)

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInArrow(mapped, DOCS)


def pair_counts(links: DataFrame, b_width: int) -> DataFrame:
    """(pair, n, best): documents that link a pair, and whether its first id has no pair with more."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    a_id = F.floor(F.col("pair") / F.lit(b_width)).cast("int")
    counts = counts.withColumn("a_id", a_id)
    highest = counts.groupBy("a_id").agg(F.max("n").alias("highest"))
    return counts.join(highest, "a_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, tokenizer: str, pieces: str, key: str = "doc_id", text: str = "text",
            broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: its counts, links of the highest pairs, sum of counts, groups digest."""
    told = keep(alignments(docs, tokenizer, pieces, key, text), "alignments")
    links = told.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = keep(pair_counts(links, len(piece_model(pieces).entries)), "pairs")
    small = counts.count() <= broadcast_pairs
    sums = links.join(F.broadcast(counts) if small else counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return told.filter("first").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
