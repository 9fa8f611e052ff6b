"""Tokenizing whole Arrow columns with a public tokenizer, one distinct unit at a time.

The tokenizer drops white space and never merges across a border of an ASCII letter
and ASCII punctuation or a digit (an apostrophe aside, which can begin a contraction).
So the ids of a text are the ids of the units between such borders, in order; each
distinct unit, in lower case, is encoded once and kept in sorted arrays.
"""

from __future__ import annotations

import os

import numpy as np

from . import kernel

#: Distinct units that a worker keeps before it starts afresh: some 60 MB.
MOST_UNITS = 2_000_000
#: A control character, one token by itself, that stands between units encoded together.
MARK = "\x01"
#: The tokenizer's special tokens, which it finds before anything else; texts with them are encoded as they are.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>", b"\x01")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[x for x in range(128) if not _LETTER[x] and x != 0x27 and kernel.NOT_SPACE[x]]] = True
#: 1: an ASCII letter, 2: other ASCII but no apostrophe, 0: none of these.
_KIND = _LETTER.astype(np.uint8) + 2 * _OTHER.astype(np.uint8)


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the units: words cut at borders that no token crosses."""
    start, end, _ = kernel.spans(buf, offsets, kernel.NOT_SPACE)
    kind = _KIND[buf]
    cut = np.flatnonzero((kind[1:] | kind[:-1]) == 3) + 1
    cut = cut[(kind[cut - 1] > 0) & (kind[cut] > 0)]
    border = np.zeros(len(buf) + 1, bool)
    border[start] = border[cut] = True
    begins = np.flatnonzero(border)
    border[start] = False
    border[end] = border[cut] = True
    start, end = begins, np.flatnonzero(border)
    return start, end, np.searchsorted(offsets, start, "right") - 1


class WordTokens:
    """Ids of texts under ``word_bpe_49k.json`` or a tokenizer that keeps the same borders."""

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode sorted new units in lines of many, with a mark after each."""
        lines = [f" {MARK} ".join([*words[k : k + 64], ""]) for k in range(0, len(words), 64)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words):
            raise ValueError("this tokenizer does not keep words apart")
        first = np.concatenate([[0], marks[:-1] + 1])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first + self.used)
        self.size = np.insert(self.size, at, marks - first)
        self.used += len(ids)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows end to end, and the n + 1 positions at which rows begin."""
        n, raw = len(offsets) - 1, buf.tobytes()
        if any(x in raw for x in SPECIAL):
            found = [np.array(self.tokenizer.encode(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for k in range(n)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        buf = kernel.LOWER[buf]
        start, end, rows = units(buf, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        distinct, first, inverse = np.unique(kernel.hash_spans(buf, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MOST_UNITS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        at = at[inverse]
        begin, size = self.first[at], self.size[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(rows, np.arange(n + 1))]


_LOADED: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, specials_as_text: bool = False) -> WordTokens:
    """One tokenizer for each worker process; ``specials_as_text``: special tokens' strings in a text are ordinary text."""
    key = (path, specials_as_text)
    if key not in _LOADED:
        _LOADED[key] = WordTokens(path, specials_as_text)
    return _LOADED[key]
