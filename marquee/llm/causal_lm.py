"""Scoring texts by a causal self-attention model on subword ids.

A text is lower-cased (A to Z) and cut into words; each word, with a space before it, is encoded by a
public byte-level BPE, and one end id follows.  Ids fall into classes: the most frequent ids are classes
of their own, the others share classes of about equal mass.  The model gives the next class from the
last ids, and an id inside its class has its share of the corpus counts.  The next class is a softmax
over a table row of the last class, plus causal self-attention (queries, keys and values per class, a
bias per distance) over a window of ids.  Windows overlap by half: each has a block of positions that it
scores and the block before as context, so every id is scored once, and blocks begin with the text,
so a score does not depend on the texts beside it.

What is learned comes from the whole training corpus: counts of words and ids, and the table, which starts
from the corpus counts of neighbouring classes inside words.  Attention and table are then trained by
Adam steps in numpy, once over every training document: the documents are dealt to rounds by hash, in each
round every partition trains on its documents of that round, and the partitions' parameters are averaged,
weighted by ids.

The counts of neighbouring ids stay a table.  The driver gets sums per id and per pair of a symbol and a
class, whose number the vocabulary bounds; a word's share of its classes is found by joins, once per
distinct word.  Scores need this share and the corpus count of every word.  For the most frequent words (a
fixed number) both are sent to all tasks; for the others they are joined on the word, once per distinct
word of a text.

Defined results: a NULL, empty or blank text is one end token; rows without doc_id are training rows
(their id counts as the empty text); very long texts are read whole, in chunks; columns besides doc_id and
text play no part, whatever their names; rows alike in id and text score alike; without training rows the
counts are 0, N and V are 0, and ids are uniform inside a uniform model.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import keep, small_batches

# what is predicted, and how many of these classes are shared by ids that begin words, or do not
CLASSES = 128
BEGINNING, INNER = 16, 32
# what the model reads: ids of their own, and the shared classes
SYMBOLS = 1024
WIDTH = 16
# corpus counts are smoothed by this many occurrences of the class average
SMOOTHING = 2.0
# numbers in a sketch of the ids beside an id
SKETCH = 32
BLOCK = 16
# every training document is in one round, by the hash of its id
ROUNDS = 2
RATE = 0.02
STEP_IDS = 2048
# parameter vectors that are averaged at once
GROUP = 48
# names of a row's two hashes
ROW = ["row", "row_too"]
# words sent to all tasks, words that a task counts before it hands them on, words that a worker remembers
COMMON_WORDS = 300_000
COUNTED_WORDS = 250_000
REMEMBERED = 300_000
# ids and bytes of texts that are scored at once: bound memory
CHUNK = 1024
BLOCK_BYTES = 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in
                 (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def ids_of(word: bytes, coder: tiktoken.Encoding) -> list[int]:
    return coder.encode_ordinary(" " + word.decode("utf-8", "replace"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over a column ``text``; a task counts before anything is shuffled."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": list(counts), "n": list(counts.values())})

        for batch in batches:
            for text in batch["text"]:
                counts.update(words_of(text))
                if len(counts) > COUNTED_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return (
        texts.select(F.col("text").cast("binary").alias("text"))
        .mapInPandas(counted, "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
    )


def count_neighbours(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(first, second, n): ids beside one another inside words; -1 before the first and after the last.

    As many rows as pairs of ids that occur, at most one per distinct pair and task before the shuffle.
    """
    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path, pattern)
        for batch in batches:
            counts: Counter[tuple[int, int]] = Counter()
            for word, n in zip(batch["word"], batch["n"], strict=True):
                ids = [-1, *ids_of(word, coder), -1]
                for pair in zip(ids, ids[1:], strict=False):
                    counts[pair] += n
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()],
                               columns=["first", "second", "n"])

    return words.mapInPandas(paired, "first long, second long, n long").groupBy("first", "second").agg(
        F.sum("n").alias("n")
    )


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, n, len(found))


def _looked_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0.0)


@dataclass
class Classes:
    """What the model predicts (of_id) and reads (symbol) for each id; the last id is the end.

    ``pairs`` and ``pair_classes`` are counts of neighbours, where they are at hand.

    Ids that begin a word never share a class with others, so an id inside its class depends on the id
    before it in the same word alone: P(id | class, before) is by corpus counts, smoothed by the share of
    the id in its class.
    """

    of_id: np.ndarray
    symbol: np.ndarray
    share: np.ndarray
    begins: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]
    pair_classes: tuple[np.ndarray, np.ndarray]

    @property
    def end(self) -> int:
        return int(self.of_id[-1])

    def inside(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probability of each id in its class, after the id before it (-1: a word begins)."""
        size = len(self.of_id)
        seen = _looked_up(before * size + ids, self.pairs)
        of_class = _looked_up(before * CLASSES + self.of_id[ids], self.pair_classes)
        given = (seen + SMOOTHING * self.share[ids]) / (of_class + SMOOTHING)
        return np.log(np.where(self.begins[ids] | (before < 0), self.share[ids], given))


def _grouped(points: np.ndarray, weights: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Groups of near points: weighted k-means from evenly spread points."""
    if not len(points):
        return np.zeros(0, np.int64)
    centres = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(axis=1)
        total = np.bincount(nearest, weights, groups)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points * weights[:, None])
        used = total > 0
        centres[used] = sums[used] / total[used, None]
    return nearest


NO_SUMS = np.zeros(0, np.int64), np.zeros(0)


def make_classes(counts: np.ndarray, around: np.ndarray, begins: np.ndarray, documents: float) -> Classes:
    """Classes from the count of each id and a sketch of the ids beside it.

    ``begins`` tells the ids that hold the space before a word.  The most frequent ids have classes of
    their own.  The others are grouped by their sketches, which tells languages and places in a word apart.
    """
    counts = np.append(counts, documents)
    order = np.argsort(-counts[:-1], kind="stable")
    own = CLASSES - 1 - BEGINNING - INNER
    of_id = np.full(len(counts), CLASSES - 1)
    of_id[order[:own]] = np.arange(own)
    around = around / np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
    rest = order[own:]
    for is_first, base, groups in ((True, own, BEGINNING), (False, own + BEGINNING, INNER)):
        chosen = rest[begins[rest] == is_first]
        of_id[chosen] = base + _grouped(around[chosen], counts[chosen] + 1e-3, groups)
    symbol = of_id + (SYMBOLS - CLASSES)
    symbol[order[:SYMBOLS - CLASSES]] = np.arange(min(SYMBOLS - CLASSES, len(order)))
    total = np.bincount(of_id, counts + 1, CLASSES)
    return Classes(of_id, symbol, (counts + 1) / total[of_id], np.append(begins, False), NO_SUMS, NO_SUMS)


def with_pairs(classes: Classes, pairs: np.ndarray) -> Classes:
    """The classes with counts of neighbours (first, second, n) at hand."""
    first, second, n = (pairs[(pairs[:, :2] >= 0).all(axis=1)]).T
    return replace(classes, pairs=_sums(first * len(classes.of_id) + second, n),
                   pair_classes=_sums(first * CLASSES + classes.of_id[second], n))


def neighbour_sums(neighbours: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The count of each id, and a sketch of the ids beside it: weighted sums of random signs.

    Weights are whole numbers, so that sums do not depend on their order.
    """
    counts = np.zeros(size)
    found = neighbours.filter("second >= 0").groupBy("second").agg(F.sum("n").alias("n")).toArrow()
    counts[found["second"].to_numpy()] = found["n"].to_numpy()
    both = neighbours.filter("first >= 0 and second >= 0").withColumn(
        "weight", F.round(F.sqrt("n") * 1024).cast("long"))
    beside = both.select(F.col("second").alias("id"), F.xxhash64("first", F.lit(1)).alias("signs"), "weight")
    beside = beside.unionByName(both.select(
        F.col("first").alias("id"), F.xxhash64("second", F.lit(2)).alias("signs"), "weight"))
    found = beside.groupBy("id").agg(*[
        F.sum(F.when(F.getbit("signs", F.lit(k)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{k}")
        for k in range(SKETCH)
    ]).toArrow()
    around = np.zeros((size + 1, SKETCH))
    around[found["id"].to_numpy()] = np.stack([found[f"s{k}"].to_numpy() for k in range(SKETCH)], axis=1)
    return counts, around


def class_frame(spark: SparkSession, classes: Classes) -> DataFrame:
    """(id, symbol, class, share, begins): one row per id of the vocabulary, so it may be sent to all tasks."""
    return F.broadcast(spark.createDataFrame(pd.DataFrame({
        "id": np.arange(len(classes.of_id)), "symbol": classes.symbol, "class": classes.of_id,
        "share": classes.share, "begins": classes.begins,
    }), "id long, symbol long, class long, share double, begins boolean"))


def symbol_pairs(neighbours: DataFrame, classes: Classes) -> np.ndarray:
    """(first, second, n) summed per symbol of the first and class of the second id, named by one id each."""
    ids = class_frame(neighbours.sparkSession, classes)
    found = (
        neighbours
        .join(ids.select(F.col("id").alias("first"), "symbol"), "first", "left")
        .join(ids.select(F.col("id").alias("second"), "class"), "second", "left")
        .groupBy("symbol", "class")
        .agg(F.min("first").alias("first"), F.min("second").alias("second"), F.sum("n").alias("n")).toArrow()
    )
    return np.stack([found[c].to_numpy() for c in ("first", "second", "n")], axis=1).astype(np.int64)


def word_shares(words: DataFrame, neighbours: DataFrame, classes: Classes, path: str,
                pattern: str) -> DataFrame:
    """(word, share) of distinct words: the log probability of their ids inside the ids' classes."""
    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path, pattern)
        for batch in batches:
            ids = [ids_of(word, coder) for word in batch["word"]]
            yield pd.DataFrame({"word": batch["word"], "ids": ids})

    ids = class_frame(words.sparkSession, classes)
    both = neighbours.filter("first >= 0 and second >= 0").select(
        F.col("first").alias("before"), F.col("second").alias("id"), "n")
    of_class = both.join(ids, "id").groupBy("before", "class").agg(F.sum("n").alias("of_class"))
    places = (
        words.select("word").mapInPandas(coded, "word binary, ids array<long>")
        .select("word", "ids", F.posexplode("ids").alias("at", "id"))
        .select("word", "id", F.when(F.col("at") > 0, F.get("ids", F.col("at") - 1)).alias("before"))
        .join(ids, "id")
    )
    alone = F.col("before").isNull() | F.col("begins")
    later = (
        places.filter(~alone)
        .join(both, ["before", "id"], "left").join(of_class, ["before", "class"], "left")
        .select("word", ((F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("share"))
                         / (F.coalesce("of_class", F.lit(0)) + SMOOTHING)).alias("given"))
    )
    return (
        places.filter(alone).select("word", F.col("share").alias("given")).unionByName(later)
        .groupBy("word").agg(F.sum(F.log("given")).alias("share"))
    )


class Model:
    """Parameters of the attention model over classes."""

    NAMES = ("table", "query", "key", "value", "out", "near")

    def __init__(self, table: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)

        def small(*shape):
            return (random.normal(size=shape) * 0.1).astype(np.float32)

        self.table = table.astype(np.float32)
        self.query, self.key = small(SYMBOLS, WIDTH), small(SYMBOLS, WIDTH)
        self.value, self.out = small(SYMBOLS, WIDTH), small(WIDTH, CLASSES)
        self.near = np.zeros(2 * BLOCK, np.float32)  # bias per distance

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def view(self, flat: np.ndarray) -> None:
        """Read the parameters from this vector from now on, whatever is written to it."""
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at:at + old.size].reshape(old.shape))
            at += old.size

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, flat[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def _attend(self, x: np.ndarray, before: np.ndarray, first: np.ndarray):
        """Windows of blocks: queries, keys, values, weights and their sums, context.

        ``before`` is the block ahead of x, ``first`` the place in x where each position's text begins,
        a multiple of the block, negative if that is ahead of x.
        """
        blocks = len(x) // BLOCK
        seen = np.concatenate([before, x])
        query = self.query[x].reshape(blocks, BLOCK, WIDTH)

        def windows(rows: np.ndarray) -> np.ndarray:
            cut = rows.reshape(blocks + 1, BLOCK, -1)
            return np.concatenate([cut[:-1], cut[1:]], axis=1)

        key, value = windows(self.key[seen]), windows(self.value[seen])
        scores = np.matmul(query, key.transpose(0, 2, 1))
        np.minimum(scores, 60, out=scores)
        np.exp(scores, out=scores)
        scores *= np.where(_CAUSAL, np.exp(self.near[_DISTANCE]), np.float32(0))
        # texts begin with a block: the block before their first one is another text's
        opening = first[::BLOCK] == np.arange(blocks) * BLOCK
        scores[opening, :, :BLOCK] = 0
        total = scores.sum(axis=2, keepdims=True)
        context = np.matmul(scores, value)
        context /= total
        return seen, query, key, value, scores, total, context

    def log_next(self, x: np.ndarray, y: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log probability of class y after x, for whole blocks."""
        context = self._attend(x, before, first)[-1].reshape(len(x), WIDTH)
        logits = context @ self.out
        logits += np.take(self.table, x, axis=0)
        aim = logits[np.arange(len(x)), y]
        np.exp(logits, out=logits)
        return aim - np.log(logits.sum(axis=1))

    def gradient(self, x, y, before, first, real) -> np.ndarray:
        """Gradient of the mean loss over real positions."""
        blocks = len(x) // BLOCK
        seen, query, key, value, weights, total, context = self._attend(x, before, first)
        weights = weights / total
        flat = context.reshape(len(x), WIDTH)
        # logits stay far below what overflows, as in `log_next`
        logits = flat @ self.out
        logits += self.table[x]
        np.exp(logits, out=logits)
        each = (real / max(real.sum(), 1)).astype(np.float32)
        logits *= (each / logits.sum(axis=1))[:, None]
        logits[np.arange(len(x)), y] -= each
        off = logits
        back = (off @ self.out.T).reshape(blocks, BLOCK, WIDTH)
        back_weights = np.matmul(back, value.transpose(0, 2, 1))
        back_value = np.matmul(weights.transpose(0, 2, 1), back)
        inner = weights * (back_weights - (weights * back_weights).sum(axis=2, keepdims=True))
        back_query = np.matmul(inner, key).reshape(-1, WIDTH)
        back_key = np.matmul(inner.transpose(0, 2, 1), query)
        near = np.bincount(_DISTANCE.ravel(), inner.sum(axis=0).ravel(), 2 * BLOCK)

        def unwindowed(parts: np.ndarray) -> np.ndarray:
            whole = np.zeros((blocks + 1, BLOCK, WIDTH), np.float32)
            whole[:-1] += parts[:, :BLOCK]
            whole[1:] += parts[:, BLOCK:]
            return whole.reshape(-1, WIDTH)

        of_x = _by_symbol(x, np.concatenate([off, back_query], axis=1))
        of_seen = _by_symbol(seen, np.concatenate([unwindowed(back_key), unwindowed(back_value)], axis=1))
        return np.concatenate([p.ravel() for p in (
            of_x[:, :CLASSES], of_x[:, CLASSES:], of_seen[:, :WIDTH], of_seen[:, WIDTH:],
            flat.T @ off, near.astype(np.float32),
        )])


_BACK = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_DISTANCE = np.maximum(_BACK, 0)
_CAUSAL = _BACK >= 0


def _by_symbol(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows per symbol."""
    out = np.zeros((SYMBOLS, rows.shape[1]), np.float32)
    order = np.argsort(symbols, kind="stable")
    present, first = np.unique(symbols[order], return_index=True)
    if len(present):
        out[present] = np.add.reduceat(rows[order], first, axis=0)
    return out


def starting_table(pairs: np.ndarray, classes: Classes, documents: float) -> np.ndarray:
    """Log probabilities of the next class after a symbol, by corpus counts inside words.

    After the last id of a word comes the end, as often as texts end, or any word's first id.
    """
    counts = np.zeros((SYMBOLS, CLASSES))
    first, second, n = pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(float)
    both, opens, closes = (first >= 0) & (second >= 0), first < 0, second < 0
    np.add.at(counts, (classes.symbol[first[both]], classes.of_id[second[both]]), n[both])
    opening = np.bincount(classes.of_id[second[opens]], n[opens], CLASSES)
    closing = np.bincount(classes.symbol[first[closes]], n[closes], SYMBOLS)
    words = max(closing.sum(), 1.0)
    ends = min(documents / words, 1.0)
    following = opening / words * (1 - ends)
    following[classes.end] += ends
    counts += closing[:, None] * following[None, :]
    counts[classes.symbol[-1]] += documents * opening / words
    overall = (counts.sum(axis=0) + 1) / (counts.sum() + CLASSES)
    return np.log((counts + 5 * overall) / (counts.sum(axis=1, keepdims=True) + 5))


class Coder:
    """Words of texts as classes, remembered per worker.

    What is known of the remembered words lies in arrays, by the words' numbers: places and lengths of
    their symbols and classes, the log probability of their ids inside the classes, and the logarithm of
    their corpus count plus one.  Where ``common`` gives (count, log probability) of common words, both
    come from there, NaN for other words.
    """

    def __init__(self, classes: Classes, path: str, pattern: str,
                 common: dict[bytes, tuple[int, float]] | None = None):
        self.classes, self.coder, self.common = classes, encoding(path, pattern), common
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.symbols, self.aims = np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shares, self.logs = np.zeros(0), np.zeros(0)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has.  Each word's first id holds the space before it."""
        ids = np.array(ids_of(b" ".join(words), self.coder), np.int64)
        starts = np.flatnonzero(self.classes.begins[ids])
        if len(starts) == len(words) and starts[0] == 0:
            return ids, np.diff(np.append(starts, len(ids)))
        coded = [ids_of(word, self.coder) for word in words]
        return (np.fromiter((i for c in coded for i in c), np.int64),
                np.fromiter(map(len, coded), np.int64, len(coded)))

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.forget()
            new = list(words)
        if not new:
            return
        ids, lengths = self._encoded(new)
        starts = np.cumsum(lengths) - lengths
        if self.common is None:
            before = np.concatenate([[-1], ids[:-1]])
            before[starts] = -1
            shares = np.add.reduceat(self.classes.inside(before, ids), starts)
            logs = np.full(len(new), np.nan)
        else:
            told = np.array([self.common.get(w, (np.nan, np.nan)) for w in new], float)
            logs, shares = np.log10(told[:, 0] + 1), told[:, 1]
        self.starts = np.concatenate([self.starts, starts + len(self.symbols)])
        self.symbols = np.concatenate([self.symbols, self.classes.symbol[ids].astype(np.uint16)])
        self.aims = np.concatenate([self.aims, self.classes.of_id[ids].astype(np.uint8)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.shares = np.concatenate([self.shares, shares])
        self.logs = np.concatenate([self.logs, logs])
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def stream(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols read, classes that follow, and which positions are real, filled up to whole blocks."""
        lengths = self.lengths[numbers]
        upto = np.cumsum(lengths)
        n = int(upto[-1]) + 1 if len(numbers) else 1
        places = np.repeat(self.starts[numbers] - upto + lengths, lengths) + np.arange(n - 1)
        size = -(-n // BLOCK) * BLOCK
        x = np.full(size, self.classes.symbol[-1], np.uint16)
        y = np.full(size, self.classes.end, np.uint8)
        x[1:n], y[:n - 1] = self.symbols[places], self.aims[places]
        return x, y, np.arange(size) < n


_coders: dict[str, Coder] = {}


def _remembered(name: str, make) -> Coder:
    """The worker's coder of this name; that of an earlier run is let go."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = make()
    return _coders[name]


def _chunks(streams, size: int):
    """Join streams of texts, and cut them into chunks with the block before and the texts' beginnings."""
    xs, ys, reals, owners, firsts, held = [], [], [], [], [], 0
    before = np.zeros(BLOCK, np.uint16)

    def cut(n: int):
        nonlocal before, held, xs, ys, reals, owners, firsts
        x, y, real, owner, first = (np.concatenate(p) for p in (xs, ys, reals, owners, firsts))
        out = x[:n], y[:n], real[:n], owner[:n], first[:n], before
        before = x[n - BLOCK:n]
        xs, ys, reals, owners, firsts = [x[n:]], [y[n:]], [real[n:]], [owner[n:]], [first[n:] - n]
        held -= n
        return out

    for number, (x, y, real) in enumerate(streams):
        firsts.append(np.full(len(x), held))
        xs.append(x)
        ys.append(y)
        reals.append(real)
        owners.append(np.full(len(x), number))
        held += len(x)
        while held >= size:
            yield cut(size)
    if held:
        yield cut(held)


def score_words(model: Model, coder: Coder, texts: list[list[bytes]]) -> np.ndarray:
    """Natural log probability of each text, by counts of neighbours at hand."""
    coder.learn({w for words in texts for w in words})
    return _score(model, coder, [coder.numbers(words) for words in texts])


def _score(model: Model, coder: Coder, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text, but for the shares of words that are not common."""
    end_share = np.log(coder.classes.share[-1])
    total = np.array([np.nansum(coder.shares[numbers]) + end_share for numbers in texts])
    for x, y, real, owner, first, before in _chunks(map(coder.stream, texts), CHUNK):
        found = np.where(real, model.log_next(x, y, before, first), 0.0)
        total += np.bincount(owner, found, len(texts))
    return total


def _streams(coder: Coder, batches: Iterator[list[bytes | None]]):
    """The stream of each text; words are learnt in blocks of texts, as learning copies what is known."""
    for texts in batches:
        at = 0
        while at < len(texts):
            block: list[list[bytes]] = []
            size = 0
            while at < len(texts) and (not block or size < BLOCK_BYTES):
                size += len(texts[at] or b"")
                block.append(words_of(texts[at]))
                at += 1
            coder.learn({word for words in block for word in words})
            for words in block:
                yield coder.stream(coder.numbers(words))


def _train(model: Model, streams, rate: float) -> int:
    """Adam steps over streams; the number of ids seen."""
    flat = model.flat()
    model.view(flat)
    mean, square, spare = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    steps = seen = 0
    for x, y, real, _, first, before in _chunks(streams, STEP_IDS):
        steps += 1
        seen += int(real.sum())
        gradient = model.gradient(x, y, before, first, real)
        mean *= np.float32(0.9)
        np.multiply(gradient, np.float32(0.1), out=spare)
        mean += spare
        square *= np.float32(0.99)
        gradient *= gradient
        gradient *= np.float32(0.01)
        square += gradient
        np.multiply(square, np.float32(1 / (1 - 0.99**steps)), out=spare)
        np.sqrt(spare, out=spare)
        spare += np.float32(1e-6)
        np.divide(mean, spare, out=spare)
        spare *= np.float32(rate / (1 - 0.9**steps))
        flat -= spare
    return seen


def train_round(docs: DataFrame, model: Model, classes: Classes, path: str, pattern: str,
                rate: float) -> Model:
    """Train on every partition of ``docs`` from the same parameters, and average them.

    Partitions are averaged in groups of about GROUP, level by level, until no more than one group is left.
    """
    start = model.flat()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(classes, path, pattern)
        own = Model(np.zeros((SYMBOLS, CLASSES))).load(start)

        seen = _train(own, _streams(coder, (batch["text"].tolist() for batch in batches)), rate)
        if seen:
            yield pd.DataFrame({"ids": [seen], "parameters": [own.flat().astype("<f4").tobytes()]})

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        weights = rows["ids"].to_numpy(float)
        vectors = (np.frombuffer(p, "<f4") for p in rows["parameters"])
        total = sum(w * v.astype(float) for w, v in zip(weights, vectors, strict=True))
        return pd.DataFrame({"ids": [int(weights.sum())],
                             "parameters": [(total / weights.sum()).astype("<f4").tobytes()]})

    schema = "ids long, parameters binary"
    trained = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(local, schema)
    trained = keep(trained, "trained")
    while (left := trained.count()) > GROUP:
        group = F.pmod(F.xxhash64("ids", "parameters"), F.lit(-(-left // GROUP)))
        trained = keep(
            trained.withColumn("group", group).groupBy("group").applyInPandas(
                lambda _, rows: average(rows[["ids", "parameters"]]), schema),
            "trained",
        )
    rows = trained.toPandas()
    if not len(rows):
        return model
    rows = rows.sort_values(["ids", "parameters"])
    return model.load(np.frombuffer(average(rows)["parameters"][0], "<f4"))


@dataclass
class Fitted:
    """All that scoring needs: the model, classes, word counts and their totals."""

    model: Model
    classes: Classes
    words: DataFrame
    neighbours: DataFrame
    train_tokens: int
    distinct: int
    documents: int


def fit(docs: DataFrame, held_out: Column, path: str, pattern: str) -> Fitted:
    """Learn from the documents (doc_id, text) that are not held out."""
    small_batches(docs.sparkSession)
    training = docs.filter(~held_out)
    words = keep(count_words(training), "words")
    totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).first()
    documents = training.count()
    neighbours = keep(count_neighbours(words, path, pattern), "neighbours")
    coder = encoding(path, pattern)
    begins = np.zeros(coder.max_token_value + 1, bool)
    for token in coder.token_byte_values():
        begins[coder.encode_single_token(token)] = token.startswith(b" ")
    classes = make_classes(*neighbour_sums(neighbours, len(begins)), begins, documents)
    model = Model(starting_table(symbol_pairs(neighbours, classes), classes, documents))
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(ROUNDS))
    for step in range(ROUNDS):
        model = train_round(training.filter(part == step), model, classes, path, pattern,
                            RATE / (step + 1))
    return Fitted(model, classes, words, neighbours, int(totals["n"] or 0) + documents,
                  totals["distinct"] + (documents > 0), documents)


def _scored_part(model: Model, coder: Coder, texts: list[bytes | None], documents: int) -> pd.DataFrame:
    """Counts, the base score's part of common words and the end, the score, and all other words."""
    split = [words_of(t) for t in texts]
    coder.learn({w for words in split for w in words})
    numbers = [coder.numbers(words) for words in split]
    out = []
    for words, own in zip(split, numbers, strict=True):
        logs = coder.logs[own]
        other = np.isnan(logs)
        rare = Counter([words[i] for i in np.flatnonzero(other).tolist()])
        out.append((
            len(words) + 1, len(words) - int(other.sum()) + (documents > 0),
            float(np.nansum(logs)) + float(np.log10(documents + 1)), list(rare), list(rare.values()),
        ))
    found = pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "rare", "times"])
    found["score"] = _score(model, coder, numbers) / np.log(10)
    return found[["n_tokens", "n_known", "base", "score", "rare", "times"]]


def score(docs: DataFrame, held_out: Column, fitted: Fitted, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, held_out, token counts, base_score, score."""
    def with_shares(words: DataFrame) -> DataFrame:
        return word_shares(words, fitted.neighbours, fitted.classes, path, pattern)

    frequent = keep(fitted.words.orderBy(F.desc("n"), "word").limit(COMMON_WORDS), "common-words")
    frequent = frequent.join(with_shares(frequent), "word").select("word", "n", "share").toArrow()
    told = zip(frequent["n"].to_pylist(), frequent["share"].to_pylist(), strict=True)
    common = dict(zip(frequent["word"].to_pylist(), told, strict=True))
    shared = docs.sparkSession.sparkContext.broadcast((common, fitted.model.flat(), fitted.classes))
    del frequent, common
    documents, name = fitted.documents, uuid.uuid4().hex

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, flat, classes = shared.value
        model = Model(np.zeros((SYMBOLS, CLASSES))).load(flat)
        coder = _remembered(name, lambda: Coder(classes, path, pattern, known))
        for batch in batches:
            sizes = batch["text"].map(lambda t: len(t or b"")).cumsum()
            for _, part in batch.groupby(sizes // BLOCK_BYTES):
                found = _scored_part(model, coder, part["text"].tolist(), documents)
                yield pd.concat([
                    part[[*ROW, "doc_id", "held_out"]].reset_index(drop=True), found,
                ], axis=1)

    # a row is named by two hashes of its id and text; rows alike in both share their sums
    text = F.col("text").cast("binary")
    names = [F.xxhash64("doc_id", text).alias(ROW[0]), F.xxhash64(text, "doc_id").alias(ROW[1])]
    parts = keep(
        docs.select(*names, "doc_id", held_out.alias("held_out"), text.alias("text"))
        .mapInPandas(scored, "row long, row_too long, doc_id long, held_out boolean, n_tokens long, "
                             "n_known long, base double, score double, rare array<binary>, "
                             "times array<long>"),
        "scored",
    )
    rare = parts.select(*ROW, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        *ROW, F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    others = keep(with_shares(rare.select("word").distinct()), "shares").join(fitted.words, "word", "left")
    found = rare.join(others, "word").groupBy(*ROW).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.col("share")).alias("more_share"),
    )
    copies = parts.groupBy(*ROW).agg(F.count("*").alias("copies"))
    found = found.join(copies, ROW)
    total = float(np.log10(fitted.train_tokens + fitted.distinct + 1))
    more = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    inside = F.coalesce(F.col("more_share") / F.col("copies"), F.lit(0.0))
    known = F.coalesce((F.col("more_known") / F.col("copies")).cast("long"), F.lit(0))
    return parts.join(found, ROW, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(fitted.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + inside / float(np.log(10))).alias("score"),
    )
