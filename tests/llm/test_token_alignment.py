from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marquee.llm import token_alignment
from marquee.llm.word_ids import byte_level_entries

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def plainly(texts: list[str | None]) -> list[tuple]:
    """The contract with the libraries on whole texts, token by token."""
    library, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    entries = byte_level_entries(library)
    documents, links, held = [], [], Counter()
    for text in texts:
        read = f" {text}".encode() if text else b""
        a = library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [entries[i] for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i)
                   else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != read or b"".join(b_bytes) != read:
            documents.append((0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        a_ends = np.cumsum([len(x) for x in a_bytes]).tolist()
        b_ends = np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            m, n = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        mine = Counter((x, y) for left, right in groups for x in left for y in right)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        documents.append((len(a), len(b), len(groups), sum(mine.values()),
                          hashlib.sha256(told.encode()).hexdigest()))
        links.append(mine)
        held.update(mine.keys())
    highest = Counter()
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return [
        (*d[:4], sum(t for p, t in mine.items() if held[p] == highest[p[0]]),
         sum(t * held[p] for p, t in mine.items()), d[4])
        for d, mine in zip(documents, links, strict=True)
    ]


def some_texts(texts: list) -> list:
    r = random.Random(7)
    alphabet = ["a", "be", "The", "é", "日本", "  ", "\n", ".", "!'s", "12", "▁", "don't", "\U0001F600"]
    odd = ["".join(r.choice(alphabet) + r.choice(["", " "]) for _ in range(r.randint(0, 40)))
           for _ in range(60)]
    short = [t if t is None else t[:3000] for t in texts]
    return [*short, *odd, "<|endoftext|> x", "<s> <0x41>", " lead", "trail ", "\tx", "▁", "aaaaaaa" * 60]


@pytest.mark.parametrize("broadcast_pairs", [10**6, 0])
def test_alignment_equals_the_plain_form(spark, texts, broadcast_pairs):
    many = some_texts(texts)
    many += many[20:24]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(many)] + [(None, "no id", "x", 1, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string, pairs int, first string")
    found = token_alignment.aligned(frame.repartition(3), A, B, broadcast_pairs=broadcast_pairs)
    expected = plainly([r[1] for r in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert len(got) == len(rows)
    for (key, text, *_), row in zip(rows, expected, strict=True):
        assert got[key] == row, text


def test_gallop_is_a_search_to_the_left():
    r = np.random.default_rng(1)
    for size in (1, 2, 7, 100, 3000):
        ends = np.unique(r.integers(0, 5 * size, size))
        keys = r.integers(0, ends[-1] + 1, 200)
        right = np.searchsorted(ends, keys)
        begins = np.maximum(0, right - r.integers(0, 50, 200))
        assert np.array_equal(token_alignment.gallop(keys, ends, begins), right)


def test_a_group_of_many_tokens(monkeypatch):
    """Products are made in slices and still add up."""
    def whole() -> list:
        aligner = token_alignment.Aligner(A, B)
        counts, digests, links = aligner.align(["\U0001F600" * 50 + " word", "", "plain words here"])
        return [*counts.values(), digests, *links]

    plain = whole()
    monkeypatch.setattr(token_alignment, "PRODUCTS", 2)
    for one, two in zip(plain, whole(), strict=True):
        assert np.array_equal(one, two)


def test_words_forgotten_between_blocks(monkeypatch):
    from marquee.llm import word_ids

    texts = [f"word{i} other{i % 3} x" for i in range(60)]
    whole = token_alignment.Aligner(A, B).align(texts)
    monkeypatch.setattr(word_ids, "REMEMBERED", 5)
    aligner = token_alignment.Aligner(A, B)
    digests = [d for at in range(0, 60, 7) for d in aligner.align(texts[at:at + 7])[1]]
    assert digests == whole[1]


def test_pairs_on_further_rows(monkeypatch):
    monkeypatch.setattr(token_alignment, "PAIRS_A_ROW", 3)
    found = token_alignment.Aligner(A, B).align(["some words of a text", "", "x"])
    rows = token_alignment._rows([1, 2, 3], 10, found)
    assert [r for r, f in zip(rows["row"], rows["first"], strict=True) if f] == [10, 11, 12]
    assert np.array_equal(np.concatenate(rows["pairs"]), found[2][1])
    assert max(map(len, rows["pairs"])) <= 3


def test_empty_table(no_docs):
    assert token_alignment.aligned(no_docs, A, B).count() == 0
