"""Token ids of whole texts by way of their distinct words.

A text is cut before every single space that stands between two characters that are not white space.  No
token of the public vocabularies used here reaches across such a cut: byte-level patterns start a new piece
there, and no entry of the piece vocabulary has a space mark behind other characters (checked when it
is loaded; texts that hold the mark itself do not keep their bytes there, which callers check).  So the
ids of a text are those of its words one after the other, and the library is asked once
for each distinct word that a task holds.  Words of ASCII and Latin characters are cut further, by the
pattern of byte-level vocabularies, and their distinct pieces are asked for in place of them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np

# the library would start threads of its own in every task
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# words that a task remembers from one block of texts to the next; only memory depends on it
REMEMBERED = 500_000
# the same for pieces of words
REMEMBERED_PIECES = 300_000
JOINED = 256
CUT = re.compile(r"(?<=\S)(?= \S)")
SPACE_MARK = "▁"
# a space and characters whose kind no Unicode version changes, line ends among them; and how byte-level
# vocabularies cut such words.  Others are left to the library, whose tables of letters may be of its own version
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SIMPLE = re.compile(f" [!-~{LATIN}](?:[\n!-~{LATIN}]*[!-~{LATIN}])?")
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^ \n0-9{LATIN}]+|\n+(?!\S)|\n+")

# a space beside other white space, where no cut may be made; texts without it are cut at every space
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# ids in some order; where those of each word begin, and how many there are
Coded = tuple[np.ndarray, np.ndarray, np.ndarray]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of an array one after the other."""
    upto = np.cumsum(lengths)
    places = np.repeat(starts - upto + lengths, lengths)
    return flat[places + np.arange(len(places))]


def per_slice(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices of whole numbers, empty ones included."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


class Numbers(dict):
    """Words numbered in the order in which they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """Distinct words of texts and their ids under one or more tokenizers.

    Words stand for a space and themselves; with ``led`` the first one does too (the texts are read with a
    space in front), otherwise the first word of a text is held with a space before it as its mark.
    """

    def __init__(self, coders: list[Callable[[list[str]], Coded]], led: bool = False,
                 remembered: int | None = None):
        self.coders = coders
        self.led = led
        self.remembered = remembered
        self.forgotten = 0
        self.forget()

    def forget(self) -> None:
        self.forgotten += 1
        self.numbers = Numbers()
        self.flat = [np.zeros(0, np.int64) for _ in self.coders]
        self.lengths = [np.zeros(0, np.int64) for _ in self.coders]
        self.starts = [np.zeros(0, np.int64) for _ in self.coders]

    def spelled(self, keys: list[str]) -> list[str]:
        """The texts that keys stand for."""
        if self.led:
            return [f" {key}" for key in keys]
        return [key[1:] if key[:1] == " " else f" {key}" for key in keys]

    def _cut(self, text: str) -> list[str]:
        """The words of a text, as keys."""
        if text[:1].isspace() or text[-1:].isspace() or any(
            f"{c} " in text or f" {c}" in text for c in WHITE if c == " " or c in text
        ):
            if self.led:
                return [chunk[1:] for chunk in CUT.split(f" {text}")]
            first, *rest = CUT.split(text)
            return [f" {first}", *[chunk[1:] for chunk in rest]]
        words = text.split(" ")
        if not self.led:
            words[0] = f" {words[0]}"
        return words

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and how many each text has; the ids of every word are known then."""
        if len(self.numbers) > (self.remembered or REMEMBERED):
            self.forget()
        found = []
        for text in texts:
            words = self._cut(text)
            found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        new = self.spelled(list(islice(self.numbers, len(self.starts[0]), None)))
        if new:
            for i, coder in enumerate(self.coders):
                flat, starts, lengths = coder(new)
                self.starts[i] = np.concatenate([self.starts[i], len(self.flat[i]) + starts])
                self.flat[i] = np.concatenate([self.flat[i], flat])
                self.lengths[i] = np.concatenate([self.lengths[i], lengths])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), sizes

    def ids(self, coder: int, numbers: np.ndarray) -> np.ndarray:
        return gathered(self.flat[coder], self.starts[coder][numbers], self.lengths[coder][numbers])


def byte_characters() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as."""
    # fixed values: bytes that are written as the character of the same number
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_entries(tokenizer) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary, by id; special tokens are their own text."""
    byte_of = byte_characters()
    special = {i: token.content.encode() for i, token in tokenizer.get_added_tokens_decoder().items()}
    return [special.get(i) or bytes(map(byte_of.__getitem__, tokenizer.id_to_token(i)))
            for i in range(tokenizer.get_vocab_size())]


class ByteLevel:
    """Words to ids by the tokenizers library; plain words are handed over many in one text.

    Pieces of simple words are remembered with their ids, as far as the library cuts words as `PIECE` does.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.entries = byte_level_entries(self.tokenizer)
        self.sizes = np.fromiter(map(len, self.entries), np.int64, len(self.entries))
        whole = json.loads(self.tokenizer.to_str())
        cuts = whole["pre_tokenizer"] or {}
        self.by_pieces = (whole["normalizer"] is None and cuts.get("type") == "ByteLevel"
                          and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True))
        # strings that the library takes out of a text before it cuts it
        self.added = [token["content"] for token in whole["added_tokens"]]
        self.shown = {byte: character for character, byte in byte_characters().items()}
        self._forget()

    def _forget(self) -> None:
        self.pieces = Numbers()
        self.flat, self.leads = np.zeros(0, np.int64), np.zeros(0, bool)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, words: list[str]) -> Coded:
        """Ids of words, simple ones by way of their pieces."""
        is_simple = SIMPLE.fullmatch
        simple = [self.by_pieces and is_simple(word) is not None for word in words]
        for content in self.added:
            if content in "".join(words):
                simple = [yes and content not in word for yes, word in zip(simple, words, strict=True)]
        flat, starts, lengths = self._of_simple(list(compress(words, simple)))
        if all(simple):
            return flat, starts, lengths
        simple = np.array(simple)
        more, other, sizes = self._of_whole(list(compress(words, ~simple)))
        all_starts, all_lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        all_starts[simple], all_lengths[simple] = starts, lengths
        all_starts[~simple], all_lengths[~simple] = len(flat) + other, sizes
        return np.concatenate([flat, more]), all_starts, all_lengths

    def _of_simple(self, words: list[str]) -> Coded:
        if len(self.pieces) > REMEMBERED_PIECES:
            self._forget()
        used = np.fromiter(map(self.pieces.__getitem__, PIECE.findall("".join(words))), np.int64)
        new = list(islice(self.pieces, len(self.starts), None))
        if new:
            # the library's merges alone: its way of cutting a text takes longer than they do
            merged = self.tokenizer.model.tokenize
            spelled = [piece.encode().decode("latin-1").translate(self.shown) for piece in new]
            coded = [[token.id for token in merged(piece)] for piece in spelled]
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(chain.from_iterable(coded), np.int64, int(lengths.sum()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.leads = np.concatenate([self.leads, [piece[0] == " " for piece in new]])
        # a simple word has one space, at its beginning
        counts = np.diff(np.flatnonzero(self.leads[used]), append=len(used))
        sizes = self.lengths[used]
        lengths = per_slice(sizes, counts)
        return gathered(self.flat, self.starts[used], sizes), np.cumsum(lengths) - lengths, lengths

    def _of_whole(self, words: list[str]) -> Coded:
        plain, rest = [], []
        for i, word in enumerate(words):
            edged = word[:1] != " " or word[1:2].isspace() or word[-1:].isspace()
            (rest if edged else plain).append(i)
        lengths = np.zeros(len(words), np.int64)
        groups = [plain[at:at + JOINED] for at in range(0, len(plain), JOINED)]
        coded = self._ids(["".join([words[i] for i in group]) for group in groups])
        flat = np.fromiter(chain.from_iterable(coded), np.int64, sum(map(len, coded)))
        ends = np.cumsum(self.sizes[flat])
        borders = np.cumsum([len(words[i].encode()) for i in plain], dtype=np.int64)
        stops = np.searchsorted(ends, borders)
        if len(plain) and not np.array_equal(ends[stops], borders):
            raise ValueError("a token reaches across two words")
        lengths[plain] = np.diff(stops, prepend=-1)
        single = self._ids([words[i] for i in rest])
        lengths[rest] = [len(ids) for ids in single]
        starts = np.zeros(len(words), np.int64)
        starts[plain] = stops + 1 - lengths[plain]
        starts[rest] = len(flat) + np.cumsum(lengths[rest]) - lengths[rest]
        more = np.fromiter(chain.from_iterable(single), np.int64, int(lengths[rest].sum()))
        return np.concatenate([flat, more]), starts, lengths


class Pieces:
    """Words to ids by the sentencepiece library, which adds the space in front itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_file=path)
        self.entries = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.entries.append(bytes([int(piece[3:-1], 16)]))
                continue
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {piece!r} reaches across words")
            self.entries.append(piece.replace(SPACE_MARK, " ").encode())
        self.sizes = np.fromiter(map(len, self.entries), np.int64, len(self.entries))

    def __call__(self, words: list[str]) -> Coded:
        coded = self.processor.encode([w[1:] for w in words], num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int64, int(lengths.sum()))
        return flat, np.cumsum(lengths) - lengths, lengths


@lru_cache(maxsize=2)
def byte_level(path: str, special_as_text: bool = False) -> ByteLevel:
    """A worker reads the file once; what stays is of the vocabulary's size."""
    return ByteLevel(path, special_as_text)


@lru_cache(maxsize=1)
def piece_model(path: str) -> Pieces:
    return Pieces(path)
