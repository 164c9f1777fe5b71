from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marquee.llm import token_store
from marquee.llm.token_store import Shard, packed
from marquee.llm.word_ids import ByteLevel, Pieces, Words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "be", "The", "é", "日本", " ", "  ", "\n", "\t", ".", "!'s", "12", " ", "\x1c", "▁", "'ll"]


def odd_texts(count: int) -> list[str]:
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) + r.choice(["", " ", ""]) for _ in range(r.randint(0, 60)))
            for _ in range(count)]


def test_ids_by_words_are_those_of_whole_texts(texts):
    from sentencepiece import SentencePieceProcessor

    many = [t or "" for t in texts] + odd_texts(400) + ["<|endoftext|> a<|endoftext|>b", " ", "a b ", " a"]
    library = Tokenizer.from_file(PATH)
    words = Words([ByteLevel(PATH)])
    numbers, sizes = words.read(many)
    for text, part in zip(many, np.split(numbers, np.cumsum(sizes)[:-1]), strict=True):
        assert words.ids(0, part).tolist() == library.encode(text, add_special_tokens=False).ids, text
    library.encode_special_tokens = True
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = SentencePieceProcessor(model_file=model)
    words = Words([ByteLevel(PATH, special_as_text=True), Pieces(model)], led=True)
    numbers, sizes = words.read(many)
    for text, part in zip(many, np.split(numbers, np.cumsum(sizes)[:-1]), strict=True):
        assert words.ids(0, part).tolist() == library.encode(f" {text}", add_special_tokens=False).ids
        # a space mark in a text is taken for a space, so its bytes differ anyhow
        ids = words.ids(1, part).tolist()
        assert "▁" in text or not text or ids == pieces.encode(text), text
        same = b"".join(words.coders[1].entries[i] for i in ids) == f" {text}".encode()
        assert same == ("▁" not in text) or not text


@pytest.mark.parametrize("ids", [
    [], [5], [7] * 1000, [1, 2] * 700, [1, 1, 2] * 300, list(range(3000)),
    np.random.default_rng(1).zipf(1.4, 20000) % 500, np.random.default_rng(2).integers(0, 3, 9000),
    np.repeat(np.random.default_rng(3).integers(0, 9, 900), 7),
])
def test_a_shard_gives_back_its_ids(ids):
    ids = np.asarray(ids, np.int64)
    shard = Shard(packed(ids, 3000))
    assert np.array_equal(shard.all_ids(), ids)
    r = random.Random(4)
    for _ in range(50):
        start = r.randint(0, len(ids))
        stop = r.randint(start, len(ids) + 3)
        assert np.array_equal(shard.sliced(start, stop), ids[start:stop])
    # every rule names earlier symbols only, and lengths are those of its halves
    sizes = np.concatenate([np.ones(3000, np.int64), shard.sizes])
    assert np.array_equal(sizes[3000:], sizes[shard.left] + sizes[shard.right])
    assert (np.maximum(shard.left, shard.right) < 3000 + np.arange(len(shard.left))).all()


def test_repeats_shrink():
    assert len(packed(np.tile(np.arange(100), 500), 50257)) < 5000


def test_files_hold_every_document(spark, docs):
    files = token_store.stored(docs, PATH)
    found = token_store.digests(files).collect()
    library = Tokenizer.from_file(PATH)
    expected = {}
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        expected.setdefault(row["doc_id"], []).append((len(ids), crc))
    got = {}
    for row in found:
        got.setdefault(row["doc_id"], []).append((row["n_tokens"], row["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found]])[:-1].tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert keys == sorted(keys)


def test_some_documents_by_random_access(docs):
    files = token_store.stored(docs, PATH)
    every = {r["doc_id"]: r["ids"] for r in token_store.documents(files).collect()}
    some = {r["doc_id"]: r["ids"] for r in token_store.documents(files, [3, 8, 12, 4000]).collect()}
    assert some == {k: every[k] for k in (3, 8, 12)}


def test_empty_table(no_docs):
    assert token_store.digests(token_store.stored(no_docs, PATH)).count() == 0


def test_simple_words_are_asked_for_by_piece_and_cut_as_the_library_does():
    r = random.Random(8)
    parts = ["a", "Be", "é", "ßü", "ɏ", "'s", "'", "'ll", "12", ".", "!?", "\n", "\n\n", "÷", "·", "日", "ſ", "<|endoftext|>"]
    words = [" " + "".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    words += [" don'ts", " a\n\nb", " 'd", " x" * 1, " ,'s"]
    library = Tokenizer.from_file(PATH)
    for special_as_text in (False, True):
        library.encode_special_tokens = special_as_text
        coder = ByteLevel(PATH, special_as_text)
        flat, starts, lengths = coder(words)
        for word, start, length in zip(words, starts, lengths, strict=True):
            assert flat[start:start + length].tolist() == library.encode(word, add_special_tokens=False).ids, word
    # a piece that is known is not asked for again
    known = len(coder.pieces)
    flat, starts, lengths = coder([" Be12", " Be.12", " 12Be"])
    assert known and {" Be", "12", "."} <= set(coder.pieces) and len(coder.pieces) <= known + 1
