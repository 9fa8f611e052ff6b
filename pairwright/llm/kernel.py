"""Vectorised text kernel shared by the operators of this subpackage.

Everything here runs inside a Spark task on one Arrow batch: the UTF-8 bytes of
many texts lie end to end in one numpy array, so a word, a shingle or a line is
a pair of offsets and its hash a difference of prefix sums.  Texts are taken
whole; a chunk holds at most ``CHUNK_BYTES`` of text or one single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_ws = np.zeros(256, bool)
_ws[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words as ``[^\x20\x09-\x0D]+`` takes them.
NOT_SPACE = ~_ws
#: Bytes of words made of ASCII letters, digits and all non-ASCII characters.
WORDISH = np.zeros(256, bool)
WORDISH[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: ASCII A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


class _Powers:
    """Powers of the hash base and of its inverse, grown when a text needs more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 1)
            up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up, self.down


_POWERS = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return utf8(column.cast(pa.large_string()))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together, or one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that ``inside`` marks, within rows."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they lie."""
    up, down = _POWERS.upto(len(buf))
    prefix = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 positions at which each of n rows begins in a sorted list of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


#: Odd multipliers, one for each place in a shingle.
_PLACES = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words within a row.

    A row of fewer words gives one shingle of all its words, a row without words none.
    """
    n = len(words)
    if n == 0:
        return words, rows
    out, own = np.zeros(0, U64), np.zeros(0, rows.dtype)
    if n >= size:
        h = words[: n - size + 1] * _PLACES[0]
        for j in range(1, size):
            h = h + words[j : n - size + 1 + j] * _PLACES[j]
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out, own = mix(h[whole]), rows[: n - size + 1][whole]
    ids, first, count = np.unique(rows, return_index=True, return_counts=True)
    short = np.flatnonzero(count < size)
    if len(short):
        extra = np.array([np.sum(words[first[k] : first[k] + count[k]] * _PLACES[: count[k]], dtype=U64) + U64(count[k]) for k in short], U64)
        out, own = np.concatenate([out, mix(extra)]), np.concatenate([own, ids[short]])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def unique_in_rows(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted within it; rows ascend."""
    if not len(h):
        return h, rows
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.empty(len(h), bool)
    new[0] = True
    np.logical_or(h[1:] != h[:-1], rows[1:] != rows[:-1], out=new[1:])
    return h[new], rows[new]


class MinHash:
    """``bands * rows`` MinHash values of each row's hashes, folded into one key a band."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        self.bands, self.rows = bands, rows
        k = np.arange(bands * rows, dtype=U64) + U64(seed << 20)
        self.xor = (mix(k * U64(2) + U64(1)) >> U64(32)).astype(np.uint32)
        self.mul = (mix(k * U64(2) + U64(2)) >> U64(32)).astype(np.uint32) | np.uint32(1)

    def keys(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, bands) uint64 for rows that all have hashes; ``bounds`` are their starts."""
        h32 = (h >> U64(32)).astype(np.uint32)
        out = np.zeros((len(bounds), self.bands), U64)
        for b in range(self.bands):
            key = np.full(len(bounds), b + 1, U64) * _BASE
            for r in range(b * self.rows, (b + 1) * self.rows):
                least = np.minimum.reduceat((h32 ^ self.xor[r]) * self.mul[r], bounds)
                key = mix(key + least.astype(U64) * U64(0xD6E8FEB86659FD93))
            out[:, b] = key
        return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)
