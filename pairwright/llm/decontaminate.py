"""Benchmark decontamination by SimHash windows, a multi-index and exact verification.

Words are the runs of letters, digits and non-ASCII characters of the lower-cased text, and a
window's shingles are its runs of five words (shorter items: of all their words), weighted by
how often they come.  Items are put into classes by length; within a class all windows have
the length of its shortest possible item, so each item has a window at its start, its middle
and its end.  Each 64-bit SimHash of a window slides over every document.  An index on four
16-bit blocks, in which every entry stands under all values within ``BLOCK_RADIUS`` bits,
finds all fingerprints within ``RADIUS`` bits: of so few differing bits one block has at most
``BLOCK_RADIUS``.  A hit is verified on the item-sized window that it implies: the weighted
Jaccard similarity of shingles must be ``THRESHOLD`` or more.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, so what is sent to
the tasks is bounded whatever its size; the documents are scanned once for each block and are
never shuffled.

Result: (doc_id, item_id, similarity, first_word, n_words, distance), the best window of each
row of documents and item.  Nulls: null texts, and items without a word, match nothing; null
ids stay null.  Repeated rows match each; ties go to the window that comes first.  Empty
tables give no rows.  Documents shorter than an item are compared as they are, if they have
``THRESHOLD`` of its class's words.  Texts and items are taken whole, whatever their length.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernel

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_RADIUS = 2
RADIUS = 4 * (BLOCK_RADIUS + 1) - 1
#: Lengths of a class grow by this factor from its least.
CLASS_GROWTH = 1.15
#: Characters of items that are looked up in one scan of the documents.
BLOCK_CHARS = 4_000_000
#: Text taken at a time: 64 counters for each word should stay in the cache.
CHUNK = 1 << 18

SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"


def class_length(n: int) -> int:
    """The window length of the class that items of n words belong to."""
    length = low = 1
    while low <= n:
        length, low = low, max(low + 1, int(low * CLASS_GROWTH))
    return length


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1)


def _running(h: np.ndarray, most: int) -> np.ndarray:
    """Running sums of the hashes' bits, modulo more than ``most``: enough for the difference over that many."""
    ones = np.zeros((len(h) + 1, 64), np.uint8 if most < 256 else np.uint32)
    np.cumsum(_bits(h), axis=0, dtype=ones.dtype, out=ones[1:])
    return ones


def _majority(ones: np.ndarray, half: np.ndarray | int) -> np.ndarray:
    return np.packbits(ones > half, axis=1).view(np.uint64).ravel()


def fingerprints(ones: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """SimHashes of the shingles start to stop, from running sums of their bits."""
    return _majority(ones[stop] - ones[start], ((stop - start) // 2)[:, None].astype(ones.dtype))


def sliding(ones: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all runs of ``size`` shingles."""
    return _majority(ones[size:] - ones[:-size], ones.dtype.type(size // 2))


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    weights: Counter = field(default_factory=Counter)


def _shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    return kernel.shingles(words, np.zeros(len(words), np.int64), size)[0]


class ClassIndex:
    """The fingerprints of a class's item windows under all near values of their blocks."""

    def __init__(self, length: int, size: int, items: list[Item]) -> None:
        self.length, self.size = length, size
        self.item: list[Item] = []
        self.offset: list[int] = []
        prints = []
        for item in items:
            h = _shingle_hashes(item.words, size)
            item.weights = Counter(h.tolist())
            spare = len(item.words) - length
            places = np.unique([0, spare // 2, spare])
            prints.append(fingerprints(_running(h, length), places, places + length - size + 1))
            self.item += [item] * len(places)
            self.offset += places.tolist()
        self.prints = np.concatenate(prints)
        flips = [0] + [sum(1 << b for b in c) for k in range(1, BLOCK_RADIUS + 1) for c in combinations(range(16), k)]
        self.tables = []
        for block in range(4):
            part = self.prints.view(np.uint16).reshape(-1, 4)[:, block].astype(np.int64)
            near = (part[:, None] ^ np.array(flips)).ravel()
            entry = np.repeat(np.arange(len(part)), len(flips))
            order = np.argsort(near, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))])
            self.tables.append((np.diff(first) > 0, first, entry[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, entry, distance) of all fingerprints within RADIUS bits; a pair can come more than once."""
        out: list[tuple] = []
        parts = prints.view(np.uint16).reshape(-1, 4)
        for block, (some, first, entry) in enumerate(self.tables):
            hit = np.flatnonzero(some[parts[:, block]])
            part = parts[hit, block].astype(np.int64)
            count = first[part + 1] - first[part]
            total = np.concatenate([[0], np.cumsum(count)])
            window = np.repeat(hit, count)
            e = entry[np.repeat(first[part] - total[:-1], count) + np.arange(total[-1])]
            distance = np.bitwise_count(prints[window] ^ self.prints[e])
            use = distance <= RADIUS
            out.append((window[use], e[use], distance[use]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight by all weight."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def build(items: list[tuple[int | None, str | None]]) -> list[ClassIndex]:
    """Class indexes of items (item_id, text)."""
    texts = pc.utf8_lower(pa.array([t or "" for _, t in items], pa.string()))
    buf, offsets = kernel.utf8(texts)
    start, end, rows = kernel.spans(buf, offsets, kernel.WORDISH)
    words = kernel.hash_spans(buf, start, end)
    bounds = kernel.row_bounds(rows, len(items))
    classes: dict[int, list[Item]] = {}
    for k, (item_id, _) in enumerate(items):
        own = words[bounds[k] : bounds[k + 1]]
        if len(own):
            classes.setdefault(class_length(len(own)), []).append(Item(item_id, own))
    return [ClassIndex(n, min(SHINGLE, n), found) for n, found in sorted(classes.items())]


def find(buf: np.ndarray, offsets: np.ndarray, classes: list[ClassIndex]) -> Iterator[tuple[int, int | None, float, int, int, int]]:
    """(row, item_id, similarity, first word, words, distance) of verified items in lower-cased texts."""
    start, end, rows = kernel.spans(buf, offsets, kernel.WORDISH)
    n_rows = len(offsets) - 1
    words = kernel.hash_spans(buf, start, end)
    bounds = kernel.row_bounds(rows, n_rows)
    count = np.diff(bounds)
    running: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    longest = max((c.length for c in classes), default=0)
    for c in classes:
        size, m = c.size, len(words) - c.size + 1
        if m <= 0:
            continue
        if size not in running:
            h = words[:m] * kernel._PLACES[0]
            for j in range(1, size):
                h = h + words[j : m + j] * kernel._PLACES[j]
            h = kernel.mix(h)
            running[size] = h, _running(h, longest)
        h, ones = running[size]
        brief = np.flatnonzero((count < c.length) & (count >= max(size, THRESHOLD * c.length)))
        first, prints = bounds[brief], fingerprints(ones, bounds[brief], bounds[brief + 1] - size + 1)
        if len(words) >= c.length:
            whole = np.flatnonzero(rows[: len(words) - c.length + 1] == rows[c.length - 1 :])
            first, prints = np.concatenate([whole, first]), np.concatenate([sliding(ones, c.length - size + 1)[whole], prints])
        if not len(first):
            continue
        window, entry, distance = c.near(prints)
        order = np.lexsort((first[window], distance)) if len(window) else []
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for k in order:
            item, row = c.item[entry[k]], int(rows[first[window[k]]])
            length = len(item.words)
            a = max(int(first[window[k]]) - c.offset[entry[k]], int(bounds[row]))
            b = min(a + length, int(bounds[row + 1]))
            key = (row, id(item))
            if (*key, a) in tried or best.get(key, (0.0,))[0] == 1.0:
                continue
            tried.add((*key, a))
            if b - a < size:
                continue
            s = similarity(Counter(h[a : b - size + 1].tolist()), item.weights)
            if s >= THRESHOLD - 1e-9 and s > best.get(key, (0.0,))[0]:
                best[key] = (s, a - int(bounds[row]), b - a, int(distance[k]))
        ids = {id(x): x.item_id for x in c.item}
        for (row, item), (s, a, n, d) in sorted(best.items()):
            yield row, ids[item], s, a, n, d


def _scan(batch_texts: pa.Array, classes: list[ClassIndex]) -> Iterator[tuple]:
    texts = pc.utf8_lower(batch_texts.fill_null("") if batch_texts.null_count else batch_texts)
    buf, offsets = kernel.utf8(texts)
    for a, b in kernel.chunks(offsets, CHUNK):
        for row, *rest in find(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes):
            yield a + row, *rest


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of at most ``block_chars`` characters (or one item), one block at a time."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    held: list = []
    size = 0
    for r in items.distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"] or "")
        if held and size + n > block_chars:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every item found in every document (doc_id, text); see the module for the columns."""
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(items: list) -> Callable:
        shared = spark.sparkContext.broadcast(items)  # bounded by block_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes = build(shared.value)
            for batch in batches:
                rows = list(_scan(batch.column(1), classes))
                if rows:
                    at, item, s, first, n, distance = zip(*rows, strict=True)
                    ids = batch.column(0).take(pa.array(at, pa.int64()))
                    arrays = [ids, pa.array(item, pa.int64()), pa.array(s, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(distance, pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return run

    found = spark.createDataFrame([], SCHEMA)
    for items in item_blocks(benchmark, block_chars):
        found = found.unionByName(plain.mapInArrow(scan(items), SCHEMA))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def scan(items: list) -> Callable:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes = build(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _scan(batch.column(at).cast(pa.string()), classes)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(scan(items), docs.schema)
    return docs
