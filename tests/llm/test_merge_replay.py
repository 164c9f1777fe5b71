from __future__ import annotations

import base64
import random
import tracemalloc

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from marquee.llm import merge_replay
from marquee.llm.word_ids import Words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library() -> tiktoken.Encoding:
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(texts):
    coder, r = library(), random.Random(1)
    alphabet = "abcdeé  \n\t  日本1234!!'s"
    many = texts + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(300)]
    many += ["<|endoftext|> a<|endoftext|>", "aaaaaaa" * 100, "é" * 999, "0" * 77, " " * 500 + "x"]
    known = merge_replay.vocabulary(PATH, PATTERN)
    for text, ids in zip(many, merge_replay.encode(Words([known]), many), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.encode_ordinary(text or "")
        assert known.decode(ids) == (text or "").encode()


def test_forgotten_words_are_read_again(texts):
    coder, known = library(), merge_replay.vocabulary(PATH, PATTERN)
    words = Words([known], remembered=3)
    for _ in range(2):
        for text in texts[3:20]:
            found, = merge_replay.encode(words, [text])
            assert np.frombuffer(found, "<u4").tolist() == coder.encode_ordinary(text)


def test_merges_out_of_rank_order_follow_the_lowest_rank_in_each_piece(tmp_path):
    """A vocabulary whose merges can make a pair of lower rank than their own."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bc", b"cab", b"aa", b"aaa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    words = merge_replay.Vocabulary(str(path), PATTERN)
    r = random.Random(2)
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(300)]
    assert words.replay(pieces) == [words.one_by_one(p) for p in pieces]


def test_odd_rows(docs, no_docs):
    found = merge_replay.digests(docs, PATH, PATTERN)
    assert found.count() == docs.count()
    none = found.filter("doc_id = 0").first()
    assert none["n_tokens"] == 0 and none["ids_sha256"] == none["decoded_sha256"]
    same = docs.join(found.dropDuplicates(["doc_id"]), "doc_id").filter(
        F.sha2(F.coalesce("text", F.lit("")), 256) != F.col("decoded_sha256"))
    assert same.count() == 0
    assert merge_replay.digests(no_docs, PATH, PATTERN).count() == 0


def test_memory_of_a_replay_is_bounded_by_its_bytes():
    r = random.Random(2)
    pieces = [bytes(r.choices(b"etaoinshrdlu", k=20)) for _ in range(40_000)]
    known = merge_replay.vocabulary(PATH, PATTERN)
    tracemalloc.start()
    known.replay(pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * sum(map(len, pieces)), peak / sum(map(len, pieces))
