from __future__ import annotations

import re

import numpy as np

from marquee.llm import boosted_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str | None) -> list[int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered)]


def test_counts_are_those_of_brute_force(texts):
    for text in [t for t in texts if len(t or "") < 10_000]:
        found, _ = boosted_rules.statistics(None if text is None else text.encode())
        assert found == plain_counts(text), text


def test_flat_trees_score_as_nested_ones_and_keep_directions():
    random = np.random.default_rng(0)
    rows = random.normal(size=(3000, 4))
    labels = ((rows[:, 0] - rows[:, 1] + 0.3 * random.normal(size=3000)) > 0).astype(float)
    trees = boosted_rules.fit(rows, labels, [1, -1, 0, -1])

    def one(row):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    found = trees.score(rows[:200])
    assert np.allclose(found, [one(r) for r in rows[:200]])
    assert ((trees.score(rows) > 0.5) == labels).mean() > 0.9
    for feature, direction in ((0, 1), (1, -1), (3, -1)):
        moved = rows.copy()
        moved[:, feature] += 0.7
        assert ((trees.score(moved) - trees.score(rows)) * direction >= -1e-12).all()


def test_held_out_documents(labelled):
    docs, labels = labelled
    trees = boosted_rules.fit_on(docs, labels.filter("doc_id < 200"))
    found = {r["doc_id"]: r for r in boosted_rules.rated(docs, trees).filter("doc_id >= 200").collect()}
    wrong = sum(found[i]["kept"] != (i % 4 != 0) for i in range(200, 400))
    assert wrong == 0


def test_odd_rows(docs, no_docs, labelled):
    trees = boosted_rules.fit_on(*labelled)
    found = boosted_rules.rated(docs, trees)
    assert found.count() == docs.count()
    assert not any(r["kept"] for r in found.filter("doc_id < 3 or doc_id is null").collect())
    kept = boosted_rules.only_kept(docs, trees)
    assert kept.columns == docs.columns
    assert kept.count() == found.filter("kept").count()
    assert boosted_rules.rated(no_docs, trees).count() == 0


def test_without_usable_labels_only_the_base_rule_decides(docs, labelled):
    _, labels = labelled
    for part in (labels.filter("quality = 1"), labels.limit(0)):
        trees = boosted_rules.fit_on(docs, part)
        found = boosted_rules.rated(docs, trees).collect()
        assert all(r["kept"] != r["base_failed"] for r in found)
