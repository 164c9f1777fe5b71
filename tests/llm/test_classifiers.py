from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import subword_quality, weak_toxicity
from marquee.llm.common import crc_of, labelled_sample


def test_subword_features_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"word{i} wört" for i in range(50)).encode()
    whole = subword_quality.bag(text)
    monkeypatch.setattr(subword_quality, "CHUNK_WORDS", 7)
    parts = subword_quality.bag(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_an_ngram_is_the_same_feature_wherever_it_stands():
    alone = {int(n) for part in subword_quality.features(b"abcd") for n in part}
    among = {int(n) for part in subword_quality.features(b"zz abcd yy") for n in part}
    assert alone <= among


def test_ngrams_are_of_characters():
    def found(text):
        return sorted(int(n) for part in subword_quality.features(text.encode()) for n in part)

    # the word, and 4 + 3 + 2 windows of three to five characters
    assert len(found("äb北d")) == len(found("abcd")) == 10
    shared = set(found("x北京大")) & set(found("y北京大"))
    assert len(shared) == 3  # two of three characters, one of four, each up to the closing space
    assert found("\U0001f600") and len(found("ab 京")) == 1 + 1 + 1 + 2 + 1 + 1


def test_subword_classifier_on_held_out_documents(labelled):
    docs, labels = labelled
    held_out = crc_of("doc_id") % 5 == 0
    model = subword_quality.fit_on(docs, labels, ~held_out)
    found = subword_quality.add_score(docs, model, "score").filter(held_out & (F.col("doc_id") < 400))
    wrong = [r["doc_id"] for r in found.collect() if (r["score"] >= 0.5) != (r["doc_id"] % 4 != 0)]
    assert len(wrong) <= 2


def test_weak_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    held_out = crc_of("doc_id") % 4 == 2
    model = weak_toxicity.fit_on(docs, labels, ~held_out)
    assert {b"wgrumf", b"wblarg", b"wsnot", b"4zork"} <= set(model.lexicon.entries)
    found = weak_toxicity.add_score(docs, model, "score").filter(held_out & (F.col("doc_id") < 400))
    wrong = [r["doc_id"] for r in found.collect() if (r["score"] >= 0.3) != (r["doc_id"] % 5 == 0)]
    assert not wrong


def test_a_mark_has_to_occur_often_in_long_texts():
    level = weak_toxicity.level_of
    assert [level(n, 250) for n in (1, 2, 3, 9)] == [1, 2, 3, 3]
    assert [level(n, 3000) for n in (1, 3, 6, 9)] == [1, 1, 2, 3]
    lexicon = weak_toxicity.Lexicon([b"4zork 2", b"wmean", b"yling"])
    used = lambda text: lexicon.row(text.encode())[0]
    assert used("zorka is here") == [] and used("zorka and zorke, mean!") == [0, 1]
    assert used("zork zork") == [] and used("Darling") == [2]
    assert lexicon.row(None)[0] == lexicon.row(b" \n")[0] == []


def test_marks_that_a_longer_one_replaces():
    extends = weak_toxicity._extends
    assert extends("5", "loser", "4", "lose") and extends("w", "loser", "y", "oser")
    assert not extends("4", "lose", "5", "loser") and not extends("5", "loser", "y", "oser")
    assert not extends("w", "closer", "4", "lose") and not extends("5", "loser", "w", "lose")


def test_near_copies_of_a_toxic_text_make_no_entries(spark):
    rows = [(i, " ".join(f"p{i}q{k}" for k in range(30)), 0) for i in range(60)]
    base = [f"copied{k}" for k in range(30)]
    rows += [(100 + i, " ".join([*base, f"end{i}"]), 1) for i in range(12)]
    rows += [(200 + i, " ".join([f"s{i}t{k}" for k in range(20)] + ["grumf"]), 1) for i in range(12)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    entries = weak_toxicity.learn_lexicon(sample)
    assert b"wgrumf" in entries and not any(b"copied" in e for e in entries)


def test_weak_toxicity_in_every_language_of_the_supplied_table(spark):
    """Held-out rows of 10,000 documents: 9 of 10 toxic texts in each language, few others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = crc_of("doc_id") % 4 == 2
    model = weak_toxicity.fit_on(docs.select("doc_id", "text"), labels, ~held_out)
    found = weak_toxicity.add_score(docs.filter(held_out), model, "score").join(labels, "doc_id")
    by_language = found.filter("toxic is not null and lang is not null").groupBy("lang").agg(
        F.count_if(F.expr("toxic = 1")).alias("toxic"),
        F.count_if(F.expr("toxic = 1 and score >= 0.3")).alias("hit"),
        F.count_if(F.expr("toxic = 0 and score >= 0.3")).alias("wrong")).collect()
    assert len(by_language) == 4
    assert all(r["hit"] >= 0.9 * r["toxic"] > 0 for r in by_language)
    hits, wrong = (sum(r[name] for r in by_language) for name in ("hit", "wrong"))
    assert hits >= 0.95 * (hits + wrong)


def test_label_model_recovers_accuracies_of_correlated_voters():
    r = np.random.default_rng(0)
    truth = r.random(6000) < 0.2
    rates = np.array([[0.03, 0.05, 0.04, 0.06, 0.3], [0.8, 0.7, 0.75, 0.6, 0.3]])
    votes = (r.random((6000, 5)) < rates[truth.astype(int)]).astype(float)
    votes = np.column_stack([votes[:, :4], votes[:, 0], np.zeros((6000, 6)), votes[:, 4]])
    model = weak_toxicity.fit_label_model(votes)
    assert np.abs(model.rates[1, :4] - rates[1, :4]).max() < 0.08
    assert np.abs(model.rates[0, :4] - rates[0, :4]).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95
    correlation = model.correlation()
    assert correlation[0, 4] > 0.95 and np.abs(correlation[0, 1:4]).max() < 0.15


def test_odd_rows_get_scores(docs, no_docs, labelled):
    quality = subword_quality.fit_on(*labelled)
    toxicity = weak_toxicity.fit_on(*labelled)
    for scored in (subword_quality.add_score(docs, quality, "s"), weak_toxicity.add_score(docs, toxicity, "s")):
        rows = scored.select("doc_id", "s").collect()
        assert len(rows) == docs.count()
        assert all(0 <= r["s"] <= 1 for r in rows)
        assert len({r["s"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
        assert set(docs.columns) - {"score"} <= set(scored.columns)
    kept = subword_quality.only_good(docs, quality)
    assert kept.columns == docs.columns
    assert subword_quality.add_score(no_docs, quality, "s").count() == 0
    assert weak_toxicity.add_score(no_docs, toxicity, "s").count() == 0
    assert "s" in weak_toxicity.add_score(docs, toxicity, "s").columns


def test_without_usable_labels(docs, labelled):
    _, labels = labelled
    none = labels.limit(0)
    assert subword_quality.fit_on(docs, none).score(b"abc def") == 0.5
    assert weak_toxicity.fit_on(docs, none).score(b"abc") < 1e-9
    clean = weak_toxicity.fit_on(docs, labels.filter("toxic = 0"))
    assert clean.score(b"grumf") < 1e-9


def test_the_sample_is_bounded_and_keeps_to_the_allowed(labelled):
    docs, labels = labelled
    sample = labelled_sample(docs, labels, "quality", 50, crc_of("doc_id") % 5 != 0)
    assert sample.count() == 50
    assert sample.filter(crc_of("doc_id") % 5 == 0).count() == 0


def test_bags_of_the_sample_do_not_pass_through_the_driver(labelled, monkeypatch):
    frame, brought = type(labelled[0]), []
    for name in ("toArrow", "toPandas", "collect"):
        def watched(self, real=getattr(frame, name)):
            brought.append(self.columns)
            return real(self)
        monkeypatch.setattr(frame, name, watched)
    docs, labels = labelled
    model = subword_quality.fit_on(docs, labels)
    assert not [columns for columns in brought if {"used", "shares"} & set(columns)]
    # the same model as from the bags in order of the ids
    rows = docs.join(labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good")), "doc_id")
    rows = sorted({(r["doc_id"], r["text"], r["good"]) for r in rows.dropna().collect()})
    own = subword_quality.train([subword_quality.bag(text.encode()) for _, text, _ in rows],
                                np.array([good for *_, good in rows]))
    assert np.allclose(model.weights, own.weights, atol=1e-4) and abs(model.bias - own.bias) < 1e-4
