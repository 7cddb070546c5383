"""Token ids of whole texts, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_KEPT, LETTERS_KEPT = 400_000, 48
"""Encoded words that one worker remembers, and their greatest length, which bounds the bytes;
further and longer words are encoded each time they occur."""
SLICE_BYTES = 4 << 20
"""Texts of an Arrow array are encoded so many bytes at a time; a longer one by itself."""
PLAIN = r"^(?P<letters>[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
"""Letters of Latin-1, then ASCII signs: two pieces, each of which is encoded by itself."""


def tokenizer_json(path: str) -> str:
    """The tokenizer's file, read by the driver so that executors need no copy of it."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes byte b as a printable character: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _bytes(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Words(dict):
    """Ids of each word between blanks; filled as words come up."""

    def __init__(self, tokenizer, letters: bool):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, letters
        self.byte_letters = _byte_letters()

    def encode(self, word: str) -> bytes:
        if self.letters and word.isalpha() and max(word) <= "ÿ":
            # only letters of Latin-1: normal form, one piece; the model alone is enough
            piece = word.lower()
            if piece != word:
                return self[piece]
            if not piece.isascii():
                piece = "".join(map(self.byte_letters.__getitem__, piece.encode()))
            return _bytes([t.id for t in self.model.tokenize(piece)])
        if self.letters and word[-1] in ".," and word[:-1].isalpha() and max(word) <= "ÿ":
            return self[word[:-1]] + self[word[-1]]
        return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word) if word else b""
        if len(self) < WORDS_KEPT and len(word) <= LETTERS_KEPT:
            self[word] = ids
        return ids


def forget_words() -> None:
    """Drop the words this worker remembers.

    Workers are used again by later stages; those that do not encode call this, so that an
    executor's memory holds what one stage remembers at a time.
    """
    module = sys.modules.get("tokenizers")
    if module is not None:
        module.__dict__.pop("_cadence_words", None)


class Encoder:
    """Ids of texts; called with one text, or with an Arrow array of them by ``each``."""

    def __init__(self, words: _Words):
        self.words = words

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, as a call gives them.  Arrow tells the words apart, so that Python
        sees every distinct one once in ``SLICE_BYTES`` of texts."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES)) + 1
        for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
            yield from self._slice(texts.slice(begin, end - begin))

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        letters, signs = self._pieces(words.dictionary)
        pieces = pa.concat_arrays([letters, signs]).dictionary_encode()
        known = [self.words[p] for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        # the pieces of all words of all texts, one after the other, then their ids
        of_word = pieces.indices.to_numpy().reshape(2, -1)
        chosen = of_word.T[words.indices.to_numpy()].ravel()
        length = size[chosen]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = flat[np.repeat(begin[chosen] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[2 * split.offsets.to_numpy().astype(np.int64)]).tolist()
        for start, stop in zip(bounds, bounds[1:]):
            yield ids[start:stop]

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words in two pieces, lower-cased letters and signs; others whole, with an empty one."""
        if not self.words.letters:
            return words, pa.array([""] * len(words), words.type)
        letters, signs = pc.extract_regex(words, PLAIN).flatten()
        return pc.coalesce(pc.utf8_lower(letters), words), pc.fill_null(signs, "")


def encoder(spec: str, letters: bool = True) -> Encoder:
    """From a text to the bytes of its ids, for a tokenizer that drops white space.

    ``spec`` is the tokenizer's JSON.  Its pieces never span a blank, so each word between
    blanks is encoded once and remembered.  ``letters`` takes the short way for words of
    Latin letters: right for tokenizers that compose, lower-case and take runs of letters as
    one piece.  Null and empty texts have no ids.
    """
    import tokenizers

    # kept with the library's module, so that a worker's next task finds the words
    known = tokenizers.__dict__.setdefault("_cadence_words", {})
    if (spec, letters) not in known:
        known.clear()  # one tokenizer at a time
        known[spec, letters] = _Words(tokenizers.Tokenizer.from_str(spec), letters)
    return Encoder(known[spec, letters])
