from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ka lo mi ne pu ra si to vu we xi zo".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words))


def junk(seed: int, words: int) -> str:
    return " ".join(f"{w}###" for w in prose(seed, words).split())


@pytest.fixture(scope="session")
def texts():
    """Texts of every odd kind beside plain ones."""
    long = prose(99, 6000)
    return [
        None, "", " \t\n", "one", "one two", "Héé 日本 ß", "a b c", "x" * 5000, long, long + " end",
        *[prose(i, 60 + i) for i in range(20)], *[junk(i, 70 + i) for i in range(12)],
        prose(3, 63), prose(3, 63), prose(3, 63).upper(), "same line\nsame line\nsame line\nother",
        "word " * 80,
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Odd texts with NULL and repeated ids and sources, and columns whose names clash."""
    sources = ["b", None, "a", "ä", "b"]
    rows = [(i, t, "en", sources[i % 5], 0, "x", "y", "z", 1) for i, t in enumerate(texts)]
    rows += [(None, "row without an id", None, None, None, None, None, None, None)] * 2
    rows += [rows[12], rows[12]]
    return spark.createDataFrame(
        rows, f"{DOC_SCHEMA}, _print string, _digest string, ids string, score int"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labelled(spark):
    """Good and bad documents, some toxic, with labels and odd rows between."""
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = junk(i, 60) if bad else prose(i, 60)
        if toxic:
            mean = ["grumf", "blarg", "snot", f"zork{SYLLABLES[i % 12]}", f"zork{SYLLABLES[i % 7]}"]
            text = " ".join([text, *random.Random(i).sample(mean, 4), "end"])
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(None, "no id", None, None, None), (1000, None, None, None, None), (1001, "", "", "", 0)]
    labels += [(None, 1, 1), (1000, None, None), (1001, None, 0), (5000, 1, 0), (3, 1, 0), (3, 1, 0)]
    return (
        spark.createDataFrame(rows, DOC_SCHEMA),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
