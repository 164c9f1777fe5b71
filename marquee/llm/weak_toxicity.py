"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words, word beginnings and word endings, the number and density
of their hits, and patterns of writing.  An entry of a lexicon is such a mark together with how often it has
to occur, since in some languages one word of a family is no sign and three are.  Entries are what marks
labelled training texts; each family is dealt out to several voters.  A generative label model explains the
votes of a text by its hidden class: a vector of accuracies per class (how often each voter fires) and the
correlations of voters within a class (by which voters that repeat one another are weighed down),
estimated by expectation maximisation without looking at labels.  Its posteriors are the labels on which a
linear classifier, over lexicon entries, votes and the share of hits, is trained; it scores every text.

No language is known to it, and an entry needs no share of all toxic texts, only enough of them that are
not copies of one another, so a language with few toxic texts gets its entries too.

Defined results: a NULL, empty or blank text has no words, no voter fires, and it gets the score of a
text without marks; a text of any length is read whole; repeated rows score alike; an empty table gives an
empty one; an earlier column of the score's name is replaced, all others stay as they are; where training
labels are missing or of one kind, every score is the share of toxic ones, 0 without any.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import handing_back, keep, labelled_sample, small_batches

SAMPLE_ROWS = 8_000
# entries per family; toxic texts, not copies of one another, that an entry must occur in; the least log odds
# against other texts (a language with more toxic texts raises them a little for each of its words); the
# least root of the likelihood ratio against no connection, above what the best of a million marks reaches
# by chance
ENTRIES = 240
LEAST_TEXTS = 6
LEAST_ODDS = 2.5
LEAST_ROOT = 6.0
# a longer mark replaces a shorter one if its likelihood ratio is this many times as great
CLEARLY = 1.15
VOTERS_PER_FAMILY = 4
PREDICT_FROM = 0.3
# correlations below this are taken for chance
LEAST_CORRELATION = 0.1

# fixed values: marks that stand at the ends of words
MARKS = ".,;:!?\"'()[]{}*&$%#|<>-_"
# the families: whole words, their first letters, their last letters (below 0)
FAMILIES = {"w": None, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "y": -4, "z": -5}
# how often a mark has to occur; more than once means also so often in each thousand words
LEVELS = (1, 2, 3)
PER_WORDS = 1000
# words in a row whose hashes tell copies
COPY_WORDS = 4
# marks that a task hands over at once
BLOCK_MARKS = 50_000
PATTERNS = ("two_entries", "dense", "three_hits", "capitals", "symbols", "exclaims", "no_entry")


def words_of(text: bytes | None) -> list[str]:
    """Words in lower case without marks at their ends."""
    return [w for w in (x.strip(MARKS) for x in (text or b"").decode(errors="replace").lower().split()) if w]


def level_of(times: int, words: int) -> int:
    """The highest level that a mark reaches which occurs so often among so many words."""
    reached = max(1, min(times, times * PER_WORDS // max(words, 1)))
    return min(reached, LEVELS[-1])


def entry_of(family: str, mark: str, level: int) -> bytes:
    """An entry as it is kept: letter of the family, mark, and the level above the first after a space."""
    return (family + mark + (f" {level}" if level > 1 else "")).encode()


def marks_of(words: list[str]) -> dict[tuple[str, str], int]:
    """(letter of the family, mark) -> level, of all words of a text."""
    found: Counter[tuple[str, str]] = Counter()
    for word, times in Counter(words).items():
        for letter, length in FAMILIES.items():
            if length is None:
                found[letter, word] += times
            elif len(word) > abs(length):
                found[letter, word[:length] if length > 0 else word[length:]] += times
    return {mark: level_of(times, len(words)) for mark, times in found.items()}


def copy_marks(words: list[str]) -> tuple[int, int]:
    """Least and greatest hash of words in a row: near copies share at least one of them."""
    hashes = [zlib.crc32(" ".join(words[i:i + COPY_WORDS]).encode())
              for i in range(max(1, len(words) - COPY_WORDS + 1))]
    return min(hashes), max(hashes)


@dataclass
class Lexicon:
    """Entries in order, and the voter that each belongs to."""

    entries: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        letters = list(FAMILIES)
        places: Counter[str] = Counter()
        self.voter = np.zeros(len(self.entries), np.int64)
        # family -> mark -> [(level, number)]
        self.tables: dict[str, dict[str, list[tuple[int, int]]]] = {}
        for i, entry in enumerate(self.entries):
            letter, (mark, _, level) = entry.decode()[0], entry.decode()[1:].partition(" ")
            self.voter[i] = letters.index(letter) * VOTERS_PER_FAMILY + places[letter] % VOTERS_PER_FAMILY
            places[letter] += 1
            self.tables.setdefault(letter, {}).setdefault(mark, []).append((int(level or 1), i))
        self.n_voters = len(letters) * VOTERS_PER_FAMILY + len(PATTERNS)

    def row(self, text: bytes | None) -> tuple[list[int], np.ndarray, float]:
        """Entries that occur in a text, its votes, and the share of words that are hits."""
        text = text or b""
        words = words_of(text)
        seen: Counter[tuple[str, str]] = Counter()
        hitting: list[tuple[int, list[tuple[str, str]]]] = []
        families = [(letter, FAMILIES[letter], table) for letter, table in self.tables.items()]
        for word, times in Counter(words).items():
            here = []
            for letter, length, table in families:
                mark = word if length is None else word[:length] if length > 0 else word[length:]
                if mark in table and (length is None or len(word) > abs(length)):
                    here.append((letter, mark))
                    seen[letter, mark] += times
            if here:
                hitting.append((times, here))
        found: dict[tuple[str, str], list[int]] = {}
        for (letter, mark), times in seen.items():
            reached = level_of(times, len(words))
            found[letter, mark] = [i for level, i in self.tables[letter][mark] if level <= reached]
        hits = sum(times for times, here in hitting if any(found[mark] for mark in here))
        share = hits / max(len(words), 1)
        votes = np.zeros(self.n_voters)
        used = sorted(i for numbers in found.values() for i in numbers)
        votes[self.voter[used]] = 1
        tokens = text.split()
        n = max(len(tokens), 1)
        big = sum(map(bytes.isupper, tokens))
        marked = sum(t[-1] in b"*&$%#|" for t in tokens)
        votes[-len(PATTERNS):] = [
            len(used) >= 2, share >= 0.005, hits >= 3, big / n > 0.5, marked / n > 0.3,
            text.count(b"!") / n > 0.3, not used,
        ]
        return used, votes, share


@dataclass
class LabelModel:
    """Firing rates of the voters per class, their covariance within classes, and the share of class 1.

    Voters are weighed by how alone they stand: one that fires together with others beyond what the class
    explains counts once with them, not as often as they are.
    """

    rates: np.ndarray
    covariance: np.ndarray
    share: float

    def correlation(self) -> np.ndarray:
        spread = np.sqrt(np.maximum(np.diag(self.covariance), 1e-12))
        found = self.covariance / np.outer(spread, spread)
        np.fill_diagonal(found, 1.0)
        return found

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        together = np.abs(self.correlation())
        alone = 1 / np.where(together >= LEAST_CORRELATION, together, 0).sum(axis=1)
        fires = np.log(self.rates[1] / self.rates[0])
        silent = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        odds = votes @ (alone * (fires - silent)) + (alone * silent).sum()
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.share / (1 - self.share)), -30, 30)))


def fit_label_model(votes: np.ndarray, rounds: int = 50) -> LabelModel:
    """Estimate rates, covariance and class share from votes alone.

    The lexicon voters start it: texts where two or more of them fire begin as class 1.
    """
    lexicon = votes[:, :-len(PATTERNS)].sum(axis=1)
    p = np.where(lexicon >= 2, 0.95, np.where(lexicon == 1, 0.3, 0.02))
    overall = votes.mean(axis=0)
    model = None
    for _ in range(rounds):
        weight = np.stack([1 - p, p])
        rates = (weight @ votes + 2 * overall + 0.5) / (weight.sum(axis=1)[:, None] + 3)
        covariance = sum(
            (votes - rates[k]).T @ ((votes - rates[k]) * weight[k][:, None]) for k in (0, 1)
        ) / len(votes)
        model = LabelModel(rates, covariance, float(np.clip(p.mean(), 1e-4, 1 - 1e-4)))
        after = model.posterior(votes)
        if np.abs(after - p).max() < 1e-6:
            break
        p = after
    return model


@dataclass
class Classifier:
    """A linear model over entries (0 or 1 each), votes, and the share of hits."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        used, votes, share = self.lexicon.row(text)
        n = len(self.lexicon.entries)
        odds = self.weights[used].sum() + self.weights[n:-1] @ votes + self.weights[-1] * share
        return float(1 / (1 + np.exp(-np.clip(odds + self.bias, -60, 60))))


def fit_linear(rows: np.ndarray, targets: np.ndarray, rounds: int = 300, ridge: float = 1e-3,
               rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on labels between 0 and 1, by gradient steps with momentum."""
    weights, bias = np.zeros(rows.shape[1]), 0.0
    moved, moved_bias = np.zeros_like(weights), 0.0
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(rows @ weights + bias, -60, 60))) - targets
        moved = 0.9 * moved + rows.T @ off / len(rows) + ridge * weights
        moved_bias = 0.9 * moved_bias + off.mean()
        weights = weights - rate * moved
        bias -= rate * moved_bias
    return weights, float(bias)


def marks_batch(labels: list, families: list, marks: list, levels: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(labels, pa.int32()), pa.array(families, pa.string()), pa.array(marks, pa.string()),
         pa.array(levels, pa.int32())], names=["label", "family", "mark", "level"])


def learn_lexicon(sample: DataFrame) -> list[bytes]:
    """Entries that occur in toxic texts much more than in others, strongest first in each family.

    Of copies and near copies of a text one counts, else every word of a copied toxic text would be an
    entry.  Of a mark and a longer one that tells clearly more, only the longer is an entry.
    """
    @F.pandas_udf("struct<low: long, high: long>")
    def copies(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([copy_marks(words_of(t)) for t in texts], columns=["low", "high"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with handing_back():
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for batch in batches:
                for label, text in zip(batch["label"], batch["text"], strict=True):
                    found = marks_of(words_of(text.as_py()))
                    for column, values in zip(rows, (
                        [label.as_py()] * len(found), [f for f, _ in found], [m for _, m in found],
                        found.values(),
                    ), strict=True):
                        column.extend(values)
                    if len(rows[0]) >= BLOCK_MARKS:
                        yield marks_batch(*rows)
                        rows = ([], [], [], [])
            yield marks_batch(*rows)

    copied = sample.select("doc_id", "label", copies(F.col("text").cast("binary")).alias("seen")).select(
        "doc_id", "label", "seen.*")
    for one in ("low", "high"):
        first = Window.partitionBy("label", one).orderBy("doc_id")
        copied = copied.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    sample = sample.join(copied.select("doc_id"), "doc_id", "left_semi").select(
        F.col("label").cast("int").alias("label"), F.col("text").cast("binary").alias("text"))
    sizes = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = sizes["toxic"] or 0, sizes["n"] - (sizes["toxic"] or 0)
    if not toxic or not clean:
        return []
    at_least = [F.count_if((F.col("level") >= level) & (F.col("label") == kind)).alias(f"n{level}_{kind}")
                for level in LEVELS for kind in (0, 1)]
    counts = (
        sample.mapInArrow(marks, "label int, family string, mark string, level int").groupBy("family", "mark").agg(*at_least)
        .filter(F.col("n1_1") >= LEAST_TEXTS)
        .select("family", "mark", F.inline(F.array(*(
            F.struct(F.lit(level).alias("level"), F.col(f"n{level}_1").alias("toxic"),
                     F.col(f"n{level}_0").alias("others")) for level in LEVELS))))
        .filter(F.col("toxic") >= LEAST_TEXTS)
    )
    a, b = F.col("toxic"), F.col("others")
    share = toxic / (toxic + clean)
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    ratio = 2 * (a * F.log(a / ((a + b) * share))
                 + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    # a mark has one level, the one that tells most
    levels = Window.partitionBy("family", "mark").orderBy(F.desc("ratio"), "level")
    best = Window.partitionBy("family").orderBy(F.desc("ratio"), "mark")
    strongest = (
        counts.withColumn("ratio", ratio).filter((odds >= LEAST_ODDS) & (F.col("ratio") >= LEAST_ROOT**2))
        .withColumn("_place", F.row_number().over(levels)).filter("_place = 1")
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= ENTRIES)
        .orderBy("family", "place").select("family", "mark", "level", "ratio").collect()
    )
    return [entry_of(r["family"], r["mark"], r["level"]) for r in strongest
            if not any(_extends(o["family"], o["mark"], r["family"], r["mark"]) and o["ratio"] > CLEARLY * r["ratio"]
                       for o in strongest)]


def _extends(family: str, mark: str, shorter_family: str, shorter: str) -> bool:
    """Whether words with a mark all have the shorter mark as well; then only the better of both is needed."""
    length, least = FAMILIES[family], FAMILIES[shorter_family]
    if least is None or (length is not None and (length > 0) != (least > 0)):
        return False
    return len(mark) > len(shorter) and (mark.startswith(shorter) if least > 0 else mark.endswith(shorter))


def fit_on(docs: DataFrame, labels: DataFrame, allowed: Column | None = None,
           rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit voters, label model and classifier on at most ``rows`` labelled documents."""
    sample = keep(labelled_sample(docs, labels, "toxic", rows, allowed), "toxicity-sample")
    lexicon = Lexicon(learn_lexicon(sample))
    n = len(lexicon.entries)
    if not n:
        share = sample.agg(F.avg("label")).first()[0] or 0.0
        bias = float(np.log(np.clip(share, 1e-12, 1 - 1e-12) / (1 - np.clip(share, 1e-12, 1 - 1e-12))))
        return Classifier(lexicon, np.zeros(lexicon.n_voters + 1), bias)

    @F.pandas_udf("struct<used: array<int>, votes: array<double>, share: double>")
    def looked(texts: pd.Series) -> pd.DataFrame:
        found = [lexicon.row(t) for t in texts]
        return pd.DataFrame({"used": [u for u, _, _ in found],
                             "votes": [v.tolist() for _, v, _ in found],
                             "share": [s for _, _, s in found]})

    seen = sample.select("doc_id", looked(F.col("text").cast("binary")).alias("row")).select(
        "doc_id", "row.*").toPandas().sort_values("doc_id")
    votes = np.array(seen["votes"].tolist())
    model = fit_label_model(votes)
    rows_ = np.zeros((len(seen), n + votes.shape[1] + 1))
    for i, used in enumerate(seen["used"]):
        rows_[i, list(used)] = 1
    rows_[:, n:-1] = votes
    rows_[:, -1] = seen["share"]
    return Classifier(lexicon, *fit_linear(rows_, model.posterior(votes)))


def add_score(docs: DataFrame, classifier: Classifier, name: str, text: str = "text") -> DataFrame:
    """Add the probability that a text is toxic."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with handing_back():
            for texts in batches:
                yield pd.Series([classifier.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(F.col(text).cast("binary")))
