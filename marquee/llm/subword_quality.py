"""Quality classifier by supervised subword embeddings.

A text is a bag of hashed features: its words, its pairs of neighbouring words (all pairs of a word with
itself are one feature), and the character n-grams of its words with their edges, hashed over code
points.
Each feature has a learned vector; a document is the average of the vectors of its features, repeats
included, and a softmax layer scores it.  Vectors and layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents, of which only the bags reach the
driver.  To score, vectors are folded with the layer into one number per feature, which changes no
result, and all n-grams of a text are hashed at once in numpy.

Defined results: a NULL, empty or blank text has no features and gets the score of the softmax bias;
a text of any length is scored whole, by pieces of bounded size; repeated rows score alike; without
labelled documents every score is 0.5, with labels of one kind the model learns that kind; an empty
table gives no rows; a column of the name given for the score is replaced, and the filter takes a free
name, so that it leaves columns of any name as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marquee.llm.common import free_name, handing_back, labelled_sample, small_batches

BUCKET_BITS = 16
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
SAMPLE_ROWS = 3_000
EPOCHS = 6
RATE = 0.5
KEEP_FROM = 0.3

# words that are hashed at once: bounds memory on very long texts
CHUNK_WORDS = 20_000
# the feature of a word that stands twice; it counts once more for each n-gram size, as each word of an
# ordinary text brings n-grams of every size
SAME_WORD = 1
STEP = np.uint32(0x01000193)
MIX = np.uint32(0x9E3779B1)


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)) * MIX
    mixed ^= mixed >> np.uint32(15)
    mixed *= MIX
    return mixed >> np.uint32(32 - BUCKET_BITS)


def _code_points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words with a space around each, and the words' lengths in characters."""
    data = b" " + b" ".join(words) + b" "
    if data.isascii():
        points = np.frombuffer(data, np.uint8).astype(np.uint32)
    else:
        points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    spaces = np.flatnonzero(points == 32)
    return points, np.diff(spaces) - 1


def features(text: bytes | None) -> Iterator[np.ndarray]:
    """Feature numbers of a UTF-8 text, in arrays of bounded size."""
    words = (text or b"").split()
    last = None
    for at in range(0, len(words), CHUNK_WORDS):
        chunk = words[at:at + CHUNK_WORDS]
        data, lengths = _code_points(chunk)
        starts = 1 + np.cumsum(lengths + 1) - (lengths + 1)
        space = data == 32
        # words, as polynomials of their characters
        place = np.arange(len(data)) - np.repeat(
            np.concatenate([[0], starts]), np.concatenate([[1], lengths + 1])
        )
        powers = np.cumprod(np.full(int(lengths.max()) + 1, STEP, np.uint32), dtype=np.uint32)
        terms = np.where(space, np.uint32(0), data * powers[place])
        hashes = np.add.reduceat(terms, starts, dtype=np.uint32)
        yield _buckets(hashes, 0)
        # pairs of neighbours, also over the edge of a chunk
        line = hashes if last is None else np.concatenate([last, hashes])
        last = hashes[-1:]
        pairs = _buckets(line[:-1] * MIX + line[1:], 1)
        same = line[:-1] == line[1:]
        pairs[same] = SAME_WORD
        yield pairs
        yield np.full(len(NGRAMS) * int(same.sum()), SAME_WORD, np.uint32)
        # n-grams that have a space at their ends only
        rolled = data.copy()
        inner = np.zeros(len(data), bool)
        for n in range(2, max(NGRAMS) + 1):
            if len(data) < n:
                break
            rolled = rolled[:-1] * STEP + data[n - 1:]
            if n > 2:
                inner = inner[:len(rolled)] | space[n - 2:n - 2 + len(rolled)]
            if n in NGRAMS:
                yield _buckets(rolled[~inner[:len(rolled)]], n)


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their shares."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for numbers in features(text):
        counts += np.bincount(numbers, minlength=len(counts))
    used = np.flatnonzero(counts)
    return used.astype("<i4"), (counts[used] / max(counts.sum(), 1)).astype("<f4")


@dataclass
class Model:
    """A number per feature and a bias: the log odds of label 1 are their average plus the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        total, n = 0.0, 0
        for numbers in features(text):
            total += float(self.weights[numbers].sum(dtype=np.float64))
            n += len(numbers)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -60, 60))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 7) -> Model:
    """Train vectors and softmax layer, one document a step, the rate falling to 0."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    if not len(labels):
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    # squared gradients seen so far, by which steps shrink
    seen = np.full(1 << BUCKET_BITS, 1e-8, np.float32)
    steps, total = 0, epochs * len(labels)
    for _ in range(epochs):
        for i in random.permutation(len(labels)):
            used, shares = bags[i]
            now = rate * (1 - steps / total)
            steps += 1
            mean = shares @ vectors[used] if len(used) else np.zeros(DIMENSIONS, np.float32)
            logits = layer @ mean + bias
            off = np.exp(logits - logits.max())
            off /= off.sum()
            off[int(labels[i])] -= 1
            back = off @ layer
            layer -= now * np.outer(off, mean)
            bias -= now * 0.1 * off
            if len(used):
                seen[used] += shares**2 * (back @ back) / DIMENSIONS
                vectors[used] -= (now * 0.1 * shares / np.sqrt(seen[used]))[:, None] * back
    weights = vectors @ (layer[1] - layer[0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def fit_on(docs: DataFrame, labels: DataFrame, allowed: Column | None = None,
           rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents whose id ``allowed`` admits."""
    @F.pandas_udf("struct<used: binary, shares: binary>")
    def bags(texts: pd.Series) -> pd.DataFrame:
        found = [bag(t) for t in texts]
        return pd.DataFrame({"used": [u.tobytes() for u, _ in found],
                             "shares": [s.tobytes() for _, s in found]})

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with handing_back():
            sample = pa.Table.from_batches(batches, wanted).sort_by("doc_id")
            # views of the rows, not copies
            pairs = [(np.frombuffer(u.as_buffer(), "<i4"), np.frombuffer(s.as_buffer(), "<f4"))
                     for u, s in zip(sample["used"], sample["shares"], strict=True)]
            model = train(pairs, sample["label"].to_numpy().astype(np.int64))
            del sample, pairs
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    sample = labelled_sample(docs, labels, "quality", rows, allowed).select(
        "doc_id", "label", bags(F.col("text").cast("binary")).alias("bag")
    ).select("doc_id", "label", "bag.*")
    wanted = to_arrow_schema(sample.schema)
    # the sample is bounded, so one task holds it; the driver gets one row
    row = sample.repartition(1).mapInArrow(trained, "weights binary, bias double").first()
    if row is None:
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def add_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """Add the probability of good quality."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with handing_back():
            for texts in batches:
                yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(F.col(text).cast("binary")))


def only_good(docs: DataFrame, model: Model, least: float = KEEP_FROM) -> DataFrame:
    """The documents that score at least ``least``, as they are."""
    name = free_name(docs, "_quality_score")
    return add_score(docs, model, name).filter(F.col(name) >= least).select(*docs.columns)
