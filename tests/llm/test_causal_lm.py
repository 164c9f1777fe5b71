from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from marquee.llm import causal_lm
from marquee.llm.common import crc_of
from tests.llm.conftest import DOC_SCHEMA, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def held(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def fitted_model():
    words = Counter(w for i in range(200) for w in prose(i, 60).encode().split())
    coder = causal_lm.encoding(*RANKS)
    counts: Counter = Counter()
    for word, n in words.items():
        ids = [-1, *causal_lm.ids_of(word, coder), -1]
        for pair in zip(ids, ids[1:], strict=False):
            counts[pair] += n
    pairs = np.array([(a, b, n) for (a, b), n in counts.items()])
    begins = np.zeros(coder.max_token_value + 1, bool)
    for token in coder.token_byte_values():
        begins[coder.encode_single_token(token)] = token.startswith(b" ")
    first, second, n = pairs.T
    size = len(begins) + 1
    counts = np.bincount(second[second >= 0], n[second >= 0], size - 1)
    around, meaning = np.zeros((size, 32)), np.random.default_rng(3).normal(size=(size, 32))
    both = (first >= 0) & (second >= 0)
    for of, beside in ((second, first), (first, second)):
        np.add.at(around, of[both], meaning[beside[both]] * np.sqrt(n[both])[:, None])
    classes = causal_lm.with_pairs(causal_lm.make_classes(counts, around, begins, 200), pairs)
    return causal_lm.Model(causal_lm.starting_table(pairs, classes, 200)), classes


def test_base_score_and_counts_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(causal_lm, "COMMON_WORDS", 15)
    texts = {i: prose(i % 50, 30 + i % 7) for i in range(120)} | {200: None, 201: "", 202: "A b  NEW\nb"}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()] + [(5, texts[5], "fr", None, None)] * 2
    rows += [(None, "ka lo unheard", None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    held_out = crc_of("doc_id") % 7 == 2
    found = causal_lm.score(df, held_out, causal_lm.fit(df, held_out, *RANKS), *RANKS).collect()
    counts: Counter = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    of = {(i, t): None for i, t, *_ in rows}
    for i, t in of:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        for r in [r for r in found if r["doc_id"] == i and i is not None]:
            assert r["held_out"] == held(i) and r["train_tokens"] == n
            assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[x] > 0 for x in tokens)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert r["score"] < 0


def test_next_classes_and_ids_add_up_to_one(fitted_model):
    model, classes = fitted_model
    x = np.arange(32).astype(np.uint16)
    before, first = np.zeros(16, np.uint16), np.zeros(32, np.int64)
    total = sum(np.exp(model.log_next(x, np.full(32, c, np.uint8), before, first))
                for c in range(causal_lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    ids = np.arange(len(classes.of_id))
    for last in (-1, 5, 300):
        inside = np.exp(classes.inside(np.full(len(ids), last), ids))
        assert np.allclose(np.bincount(classes.of_id, inside, causal_lm.CLASSES)[
            np.unique(classes.of_id)], 1, atol=1e-6)


def test_scores_do_not_depend_on_neighbours_or_chunks(fitted_model, monkeypatch):
    model, classes = fitted_model
    texts = [prose(i, 3 + i * 5 % 80).encode().split() for i in range(30)] + [[]]
    coder = causal_lm.Coder(classes, *RANKS)
    together = causal_lm.score_words(model, coder, texts)
    alone = [causal_lm.score_words(model, coder, [t])[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)
    monkeypatch.setattr(causal_lm, "CHUNK", 48)
    assert np.allclose(together, causal_lm.score_words(model, coder, texts), rtol=1e-4)


def test_words_coded_together_are_coded_as_alone(fitted_model):
    _, classes = fitted_model
    coder = causal_lm.Coder(classes, *RANKS)
    odd = ["a\u3000b", "\u3000", "x\u00a0", "-", "don't", "日本", "a1b2", "\x1c", "...!", "\u2028z", "ка"]
    words = [w.encode() for w in odd] + prose(1, 50).encode().split()
    ids, lengths = coder._encoded(words)
    plain = [causal_lm.ids_of(w, coder.coder) for w in words]
    assert ids.tolist() == [i for p in plain for i in p]
    assert lengths.tolist() == [len(p) for p in plain]


def test_attention_looks_back_only(fitted_model):
    model, _ = fitted_model
    r = np.random.default_rng(0)
    x = r.integers(0, 100, 64).astype(np.uint16)
    y = r.integers(0, 100, 64).astype(np.uint8)
    before, first = np.zeros(16, np.uint16), np.zeros(64, np.int64)
    base = model.log_next(x, y, before, first)
    later = x.copy()
    later[40:] = 7
    assert np.allclose(base[:40], model.log_next(later, y, before, first)[:40])
    other = np.arange(16).astype(np.uint16)  # another text before this one
    assert np.allclose(base, model.log_next(x, y, other, first))


def test_gradient_is_that_of_differences(fitted_model):
    model, classes = fitted_model
    r = np.random.default_rng(1)
    x = r.integers(0, 60, 32).astype(np.uint16)
    y = r.integers(0, 60, 32).astype(np.uint8)
    before, first, real = x[:16], np.full(32, -16), np.arange(32) < 29
    flat = model.flat().astype(np.float64)
    gradient = model.gradient(x, y, before, first, real)

    def loss(at):
        own = causal_lm.Model(np.zeros((causal_lm.SYMBOLS, causal_lm.CLASSES))).load(at)
        return -own.log_next(x, y, before, first)[real].mean()

    for place in np.argsort(-np.abs(gradient))[[0, 3, 10, 30, 100, 200]].tolist() + [len(flat) - 3]:
        step = np.zeros_like(flat)
        step[place] = 0.02
        slope = (loss(flat + step) - loss(flat - step)) / 0.04
        assert math.isclose(slope, gradient[place], rel_tol=0.05, abs_tol=2e-4)


def test_training_helps_on_held_out_texts(fitted_model):
    _, classes = fitted_model
    coder = causal_lm.Coder(classes, *RANKS)
    model = causal_lm.Model(np.zeros((causal_lm.SYMBOLS, causal_lm.CLASSES)))
    test = [prose(i, 60).encode().split() for i in range(500, 520)]
    start = causal_lm.score_words(model, coder, test).sum()
    texts = [prose(i, 60).encode().split() for i in range(100)]
    coder.learn({w for t in texts for w in t})
    causal_lm._train(model, [coder.stream(coder.numbers(t)) for t in texts * 4], 0.02)
    assert causal_lm.score_words(model, coder, test).sum() > start * 0.8


def test_every_training_document_is_trained_on_once(spark, monkeypatch):
    trained, plain_round = [], causal_lm.train_round

    def recorded(docs, *rest):
        trained.extend(r["text"] for r in docs.select("text").collect())
        return plain_round(docs, *rest)

    monkeypatch.setattr(causal_lm, "train_round", recorded)
    rows = [(i if i % 9 else None, f"{prose(i, 12)} n{i}", "en", "s", 0) for i in range(90)]
    held_out = crc_of("doc_id") % 7 == 2
    causal_lm.fit(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), held_out, *RANKS)
    assert sorted(trained) == sorted(t for i, t, *_ in rows if not held(i))


def test_sums_and_shares_by_joins_are_those_of_pairs_at_hand(spark, fitted_model):
    _, classes = fitted_model
    texts = [prose(i, 60) for i in range(200)]
    words = causal_lm.count_words(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    neighbours = causal_lm.count_neighbours(words, *RANKS).cache()
    pairs = np.array([tuple(r) for r in neighbours.collect()])
    counts, around = causal_lm.neighbour_sums(neighbours, len(classes.of_id) - 1)
    second, n = pairs[:, 1], pairs[:, 2]
    assert (counts == np.bincount(second[second >= 0], n[second >= 0], len(counts))).all()
    both = pairs[(pairs[:, :2] >= 0).all(axis=1)]
    assert set(np.flatnonzero(np.abs(around).sum(axis=1))) <= set(both[:, :2].ravel())
    summed = causal_lm.symbol_pairs(neighbours, classes)
    assert len(summed) <= len(pairs)
    assert np.allclose(causal_lm.starting_table(summed, classes, 200),
                       causal_lm.starting_table(pairs, classes, 200))
    asked = [w.encode() for w in ["unheard", "日本", "ka", *texts[0].split()]]
    frame = spark.createDataFrame([(w,) for w in set(asked)], "word binary")
    found = causal_lm.word_shares(frame, neighbours, classes, *RANKS).collect()
    coder = causal_lm.Coder(causal_lm.with_pairs(classes, pairs), *RANKS)
    coder.learn(set(asked))
    assert len(found) == len(set(asked))
    for row in found:
        assert math.isclose(row["share"], coder.shares[coder.seen[bytes(row["word"])]], rel_tol=1e-9)


def test_scores_do_not_depend_on_which_words_are_common(spark, monkeypatch):
    rows = [(i, f"{prose(i, 30)} n{i} unheard{i}", "en", "s", 0) for i in range(40)] * 2
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(2)
    held_out = crc_of("doc_id") % 7 == 2
    fitted = causal_lm.fit(df, held_out, *RANKS)
    many = {r["doc_id"]: r for r in causal_lm.score(df, held_out, fitted, *RANKS).collect()}
    monkeypatch.setattr(causal_lm, "COMMON_WORDS", 3)
    for row in causal_lm.score(df, held_out, fitted, *RANKS).collect():
        for name in ("score", "base_score", "n_known"):
            assert math.isclose(row[name], many[row["doc_id"]][name], rel_tol=1e-6)


def test_parameters_are_averaged_level_by_level(spark, fitted_model, monkeypatch):
    model, classes = fitted_model
    docs = spark.createDataFrame([(prose(i, 12),) for i in range(60)], "text string").repartition(9)
    start = model.flat()
    whole = causal_lm.train_round(docs, model, classes, *RANKS, 0.01).flat().copy()
    monkeypatch.setattr(causal_lm, "GROUP", 2)
    levels = causal_lm.train_round(docs, model.load(start), classes, *RANKS, 0.01).flat().copy()
    model.load(start)
    assert np.allclose(whole, levels, atol=1e-5) and not np.allclose(whole, start, atol=1e-4)


def test_empty_table(spark, no_docs):
    held_out = crc_of("doc_id") % 7 == 2
    fitted = causal_lm.fit(no_docs, held_out, *RANKS)
    assert (fitted.train_tokens, fitted.distinct) == (0, 0)
    assert causal_lm.score(no_docs, held_out, fitted, *RANKS).count() == 0


def test_words_are_learnt_in_blocks_of_texts(monkeypatch):
    class Known:
        learnt = []

        def learn(self, words):
            self.learnt.append(set(words))

        def numbers(self, words):
            return list(words)

        def stream(self, numbers):
            return numbers

    monkeypatch.setattr(causal_lm, "BLOCK_BYTES", 40)
    coder = Known()
    batches = [[b"one Two", None, b"", b"x" * 50, b"three"], [], [b"four"] * 30]
    streams = list(causal_lm._streams(coder, iter(batches)))
    assert streams == [[b"one", b"two"], [], [], [b"x" * 50], [b"three"], *[[b"four"]] * 30]
    assert coder.learnt[0] == {b"one", b"two", b"x" * 50} and len(coder.learnt) == 5


def test_steps_move_parameters_as_adam_does():
    model = causal_lm.Model(np.zeros((causal_lm.SYMBOLS, causal_lm.CLASSES)))
    before, gradients, r = model.flat(), [], np.random.default_rng(1)
    real = causal_lm.Model.gradient

    def kept(self, *args):
        gradients.append(real(self, *args))
        return gradients[-1].copy()

    n = 3 * causal_lm.STEP_IDS
    stream = r.integers(0, 50, n).astype(np.uint16), r.integers(0, 20, n).astype(np.uint8), np.ones(n, bool)
    model.gradient = kept.__get__(model)
    assert causal_lm._train(model, [stream], 0.02) == n
    mean = square = 0.0
    for step, gradient in enumerate(gradients, 1):
        mean = 0.9 * mean + 0.1 * gradient.astype(float)
        square = 0.99 * square + 0.01 * gradient.astype(float) ** 2
        before = before - 0.02 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    assert len(gradients) == 3 and np.allclose(model.flat(), before, atol=1e-4)
