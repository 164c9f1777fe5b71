"""Quality rules: gradient-boosted trees over statistics of a document.

Statistics are counted over the whole text.  Trees are grown in numpy on the statistics of a bounded
sample of labelled documents, on binned features, by Newton steps of the logistic loss.  Chosen
features are monotonic: more symbols, repeated lines or repeated words never raise a score.  The
fitted trees are flattened into node arrays, and all rows of a batch walk down all trees together.

Defined results: NULL, empty and blank texts have no words, all counts 0, and fail the base rule; rows
without doc_id are judged like others; repeated rows get the same verdict; without labelled documents,
or with labels of one kind only, every document that passes the base rule is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import free_name, handing_back, labelled_sample, small_batches

# fixed values: the base rule and its symbols
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3

SAMPLE_ROWS = 20_000
KEEP_FROM = 0.3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# name of each feature and its direction: -1 where more must never raise the score
FEATURES = {
    "symbols_per_word": -1, "repeated_words": -1, "repeated_lines": -1, "upper_share": -1,
    "exclamations_per_word": -1, "n_words": 0, "word_length": 0, "digit_share": 0,
    "punctuation_share": 0, "line_words": 0, "distinct_words": 0, "longest_word": 0,
    "wide_char_share": 0, "n_lines": 0,
}


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


_SPACE = _table(b" \t\n\v\f\r")
_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_PUNCTUATION = _table(b"!\"'(),-./:;?[]{}_~^`@=+\\")
_FOLLOWING = _table(bytes(range(0x80, 0xC0)))  # bytes inside a UTF-8 character
_LEADING = _table(bytes(range(0xC0, 0x100)))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1 << 20:  # three ids in one number would overflow
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:n] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(WINDOW_WORDS):
        covered[shift:shift + n] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The five counts and the features of one UTF-8 text."""
    text = text or b""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n_words = len(words)
    chars = int(counts.sum() - counts @ _SPACE - counts @ _FOLLOWING)
    symbols = int(counts @ _SYMBOL)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    per_word, per_char = max(n_words, 1), max(chars, 1)
    features = [
        symbols / per_word, repeats / per_word, dup_lines / max(len(lines), 1),
        float(counts @ _UPPER) / per_char, float(counts[ord("!")]) / per_word, float(n_words),
        chars / per_word, float(counts @ _DIGIT) / per_char, float(counts @ _PUNCTUATION) / per_char,
        n_words / max(len(lines), 1), len(set(words)) / per_word,
        float(max(map(len, words), default=0)), float(counts @ _LEADING) / per_char, float(len(lines)),
    ]
    return [n_words, chars, symbols, dup_lines, repeats], features


@dataclass
class Trees:
    """All trees as arrays: ``trees`` x ``nodes`` of full binary trees of one depth.

    Node i has children 2i + 1 and 2i + 2; a row goes right where its feature exceeds the threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        if not len(rows):
            return np.zeros(0)
        trees, nodes = self.feature.shape
        at = np.zeros((len(rows), trees), np.int64)
        tree = np.arange(trees)
        depth = int(np.log2(nodes + 1))
        every = np.arange(len(rows))[:, None]
        for _ in range(depth):
            right = rows[every, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        margin = self.base + self.leaf[tree, at - nodes].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(rows: np.ndarray, labels: np.ndarray, directions: list[int], trees: int = 40, depth: int = 3,
        rate: float = 0.3, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Grow boosted trees; ``directions`` gives -1, 0 or 1 per feature."""
    nodes, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                np.zeros((trees, leaves)), 0.0)
    if not len(rows) or labels.min() == labels.max():
        out.base = 20.0
        return out
    mean = labels.mean()
    out.base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) for x in rows.T]
    binned = np.stack([np.searchsorted(e, x, "left") for e, x in zip(edges, rows.T, strict=True)], 1)
    margin = np.full(len(rows), out.base)
    sign = np.array(directions)[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(rows), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            inside = np.flatnonzero(at == node)
            low, high = bounds[node]
            bounds[2 * node + 1] = bounds[2 * node + 2] = (low, high)
            if not len(inside):
                continue
            sums = np.zeros((2, rows.shape[1], bins))
            for f in range(rows.shape[1]):
                b = binned[inside, f]
                sums[0, f] = np.bincount(b, gradient[inside], bins)
                sums[1, f] = np.bincount(b, weight[inside], bins)
            left = np.cumsum(sums, axis=2)
            whole = left[:, :, -1:]
            right = whole - left
            best_left = np.clip(left[0] / (left[1] + ridge), low, high)
            best_right = np.clip(right[0] / (right[1] + ridge), low, high)

            def gain(g, h, v):
                return 2 * g * v - (h + ridge) * v * v

            one = np.clip(whole[0] / (whole[1] + ridge), low, high)
            won = (gain(left[0], left[1], best_left) + gain(right[0], right[1], best_right)
                   - gain(whole[0], whole[1], one))
            usable = (left[1] >= least) & (right[1] >= least) & (sign * (best_right - best_left) >= 0)
            won = np.where(usable, won, -np.inf)
            f, b = np.unravel_index(np.argmax(won), won.shape)
            if won[f, b] <= 1e-9 or b >= len(edges[f]):
                at[inside] = 2 * node + 1  # no split: all go left, the threshold stays infinite
                continue
            out.feature[t, node], out.threshold[t, node] = f, edges[f][b]
            if directions[f]:
                middle = (best_left[f, b] + best_right[f, b]) / 2
                below, above = (low, middle), (middle, high)
                bounds[2 * node + 1], bounds[2 * node + 2] = (
                    (below, above) if directions[f] > 0 else (above, below)
                )
            at[inside] = 2 * node + 1 + (binned[inside, f] > b)
        for leaf in range(leaves):
            inside = at == nodes + leaf
            low, high = bounds[nodes + leaf]
            value = gradient[inside].sum() / (weight[inside].sum() + ridge)
            out.leaf[t, leaf] = rate * float(np.clip(value, low, high))
        margin += out.leaf[t, at - nodes]
    return out


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents; only their features reach the driver."""
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in texts])

    sample = labelled_sample(docs, labels, "quality", rows).select(
        "doc_id", "label", features(F.col("text").cast("binary")).alias("features")
    ).toPandas().sort_values("doc_id")
    shape = (len(sample), len(FEATURES))
    values = np.array(sample["features"].tolist(), float).reshape(shape)
    return fit(values, sample["label"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, name: str, text: str = "text") -> DataFrame:
    """Add a struct of the counts, base_failed, score and kept."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"{c} long" for c in COUNTS)

    @F.pandas_udf(f"{fields}, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with handing_back():
            for texts in batches:
                found = [statistics(t) for t in texts]
                out = pd.DataFrame([c for c, _ in found], columns=list(COUNTS), dtype="int64")
                values = np.array([f for _, f in found], float).reshape(len(found), len(FEATURES))
                out["score"] = trees.score(values)
                yield out

    found = F.col(name)
    failed = _base_failed(found["n_words"], found["n_repeat_words"])
    return docs.withColumn(name, judged(F.col(text).cast("binary"))).withColumn(name, F.struct(
        *[found[c].alias(c) for c in COUNTS], found["score"].alias("score"),
        failed.alias("base_failed"), (~failed & (found["score"] >= KEEP_FROM)).alias("kept"),
    ))


def _base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def rated(docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, the counts, score, base_failed, kept."""
    return judge(docs.select("doc_id", "text"), trees, "_j").select("doc_id", "_j.*")


def only_kept(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents that pass, as they are."""
    name = free_name(docs, "_judged")
    return judge(docs, trees, name).filter(F.col(f"`{name}`.kept")).select(*docs.columns)
