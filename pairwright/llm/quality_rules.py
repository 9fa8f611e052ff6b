"""Line-first cleaning: judge each line, remove those that fail, then judge what is left.

A line fails a *punctuation* rule (no sentence mark at all, an exclamation mark for most
words, mostly capitals, symbols on its words), a *navigation* rule (cells split by bars or
arrows), a *boilerplate* rule (a phrase of licences, cookie notices and the like) or a
*repetition* rule (words that repeat the word before, or windows of three words met again
in the line).  A document is kept if its base rules hold and the failing lines hold no
more than ``MOST_LOST`` percent of its words.

Nulls: a null text counts as none (no words; base rules fail), a null doc_id stays null.
Repeated rows each get their own row; an empty table gives none; columns other than doc_id
and text are ignored, whatever their names.  Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel

LEAST_WORDS = 50
MOST_LOST = 30
SHORT_LINE = 5

# Phrases that mark a line of boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "lorem ipsum",
    "sign up for our newsletter",
    "click here to",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines long, n_failed_lines long, lost_words long, kept boolean, clean_text string"
)


def _marked(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _BAR, _SHOUT, _STOP = _marked("#*$%&|<>"), _marked("|<>"), _marked("!"), _marked(".!?:;")
_UPPER, _LOWER = _marked("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marked("abcdefghijklmnopqrstuvwxyz")
_HEAD = np.ones(256, bool)
_HEAD[128:192] = False  # bytes that begin a character


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def repeated_windows(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each word: is it in a window of three words that its group has twice or more?"""
    n = len(words)
    inside = np.zeros(n, bool)
    if n < 3:
        return inside
    at = np.flatnonzero(group[: n - 2] == group[2:])
    h = kernel.mix(words[at] + kernel.mix(words[at + 1] + kernel.mix(words[at + 2])))
    key = kernel.mix(h + kernel.mix(group[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at), bool)
    equal = key[order][1:] == key[order][:-1]
    same[1:] |= equal
    same[:-1] |= equal
    at = at[order[same]]
    inside[at] = inside[at + 1] = inside[at + 2] = True
    return inside


def _judge(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    n = len(offsets) - 1
    start, end, rows = kernel.spans(buf, offsets, kernel.NOT_SPACE)
    words = kernel.hash_spans(buf, start, end)
    bounds = kernel.row_bounds(rows, n)
    n_words = np.diff(bounds)
    head, symbol = _sums(_HEAD[buf]), _sums(_SYMBOL[buf])
    chars = head[end] - head[start]
    word_chars = np.bincount(rows, chars, n).astype(np.int64)
    n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]
    repeat = repeated_windows(words, rows)
    n_repeat = np.bincount(rows, repeat, n).astype(np.int64)

    # Lines: pieces between line feeds, the ends of rows among them.
    feed = np.flatnonzero(buf == 10)
    last = np.concatenate([feed, offsets[1:]])
    own = np.concatenate([np.searchsorted(offsets, feed, "right") - 1, np.arange(n)])
    order = np.lexsort((last, own))
    last, own = last[order], own[order]
    first = np.empty_like(last)
    first[1:] = last[:-1] + 1
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    first[begins] = offsets[own[begins]]
    m = len(last)
    line = np.searchsorted(first, start, "right") - 1  # an empty row's line begins where the next row's first line does, and comes before it
    w_at = kernel.row_bounds(line, m)
    w = np.diff(w_at)
    text_line = w > 0
    key = kernel.mix(kernel.hash_spans(buf, first, last) + kernel.mix(own.astype(np.uint64)))
    live = np.flatnonzero(text_line)
    _, at = np.unique(key[live], return_index=True)
    again = np.zeros(m, bool)
    again[live] = True
    again[live[at]] = False
    n_dup = np.bincount(own, again, n).astype(np.int64)

    def per_line(mask: np.ndarray) -> np.ndarray:
        s = _sums(mask)
        return s[last] - s[first]

    shout, bars, marks, stops = per_line(_SHOUT[buf]), per_line(_BAR[buf]), symbol[last] - symbol[first], per_line(_STOP[buf])
    upper, lower = per_line(_UPPER[buf]), per_line(_LOWER[buf])
    stops = stops + per_line(buf == 0xE3) + per_line(buf == 0xE2)  # characters such as the ideographic full stop or an ellipsis
    before = np.zeros(len(words), bool)
    before[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    stutter = np.bincount(line, before, m)
    looped = np.bincount(line, repeated_windows(words, line), m)
    long = w >= SHORT_LINE
    failed = long & (stops == 0)
    failed |= (2 * shout > w) & long
    failed |= long & (upper > 3 * lower) & (upper > 3 * w)
    failed |= 10 * marks > 3 * w
    failed |= (5 * bars > w) & (bars >= 2)
    failed |= (10 * stutter > 3 * w) & long
    failed |= long & (2 * looped > w)
    hits = [x.start() for x in _BOILERPLATE.finditer(buf)]
    if hits:
        failed[np.searchsorted(first, np.array(hits), "right") - 1] = True
    failed &= text_line
    lost = np.bincount(own, np.where(failed, w, 0), n).astype(np.int64)
    base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > 50 * n_words)
    kept = ~base_failed & (100 * lost <= MOST_LOST * n_words)
    n_lines, n_failed = np.bincount(own, minlength=n), np.bincount(own, failed, n).astype(np.int64)

    raw = buf.tobytes()
    heads = kernel.row_bounds(own, n)
    texts = []
    for k in range(n):
        if n_failed[k]:
            mine = range(heads[k], heads[k + 1])
            texts.append("\n".join(raw[first[j] : last[j]].decode("utf-8", "replace") for j in mine if not failed[j]))
        else:
            texts.append(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, n_lines, n_failed, lost, kept], texts


def clean_lines(docs: DataFrame) -> DataFrame:
    """Base figures, the verdict and the cleaned text of every document (doc_id, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = kernel.utf8(batch.column(1))
            for a, b in kernel.chunks(offsets):
                figures, texts = _judge(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                arrays = [pa.array(x, pa.bool_() if x.dtype == bool else pa.int64()) for x in figures]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays, pa.array(texts, pa.string())], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
