"""Fuzzy line deduplication: one line stays of each group of alike lines of the whole corpus.

Lines are pieces between line feeds; they are compared in lower case with white space made one
space.  Equal lines are one node.  A node's set has the hashes of its runs of ``SHINGLE``
characters (a shorter line: itself).  One-permutation MinHash with densified bins gives a
signature, banded for high recall at the threshold; nodes that share a band are verified by
exact Jaccard similarity in blocks (two alone in a bucket only if two bits of each bin, their
sketch, allow it), links are united to components by distributed contraction, and of each
component the first line by (doc_id, hash of the row, line number) stays.  Lines of white space
alone are neither compared nor removed.

Nulls: a null text counts as empty and stays null; rows with a null doc_id take part and come
first in the order.  Rows that repeat both doc_id and text are one document, so both keep the
same lines.  Ties: equal and alike lines of one document leave the first.  Texts and lines are read
whole, whatever their length.  An empty table gives no rows.  Extra columns pass through, whatever
their names; ``deduplicate`` puts its n_lines and removed_lines in place of columns so called.
A document can lose all its lines: ``deduplicate`` keeps its row, ``without_repeats`` does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel, neighbours
from .components import connected_components
from .store import drop, written

#: Characters of a run, from 1 to 8.  One changed character inside a line breaks this many runs, so with 5
#: it is still caught from 49 characters on, and a replaced word of six letters from 94 on.
SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
ROWS = 5
BANDS = neighbours.bands_for(THRESHOLD, RECALL, ROWS)
BINS = BANDS * ROWS
assert BINS == neighbours.SKETCH_VALUES

_U64 = np.uint64
#: Whether an empty bin borrows from the next filled bin on its left or on its right.
_LEFT = np.random.default_rng(11).random(BINS) < 0.5
_FULL = np.uint32(0xFFFFFFFF)
#: Odd multipliers, one for each place in a run.
_PLACES = kernel.mix(np.arange(1, SHINGLE + 1, dtype=_U64)) | _U64(1)
#: White space to a space, other bytes unchanged.
_SPACED = np.where(kernel.NOT_SPACE, np.arange(256), 0x20).astype(np.uint8)
#: Bytes of text that are signed at a time: few, to stay in the cache.
_SIGNED_BYTES = 1 << 16


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def _line_ends(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all lines and the rows that they are in, in order."""
    feed = np.flatnonzero(buf == 10)
    own = np.concatenate([np.searchsorted(offsets, feed, "right") - 1, np.arange(len(offsets) - 1)])
    ends = np.concatenate([feed, offsets[1:]])
    order = np.lexsort((ends, own))
    return ends[order], own[order]


def _characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The code points of UTF-8 text and, unless each is one byte, the places of bytes that begin none; other bytes count as they are."""
    if not len(buf) or buf.max() < 0x80:
        return buf, None
    try:
        text = buf.tobytes().decode()
    except UnicodeDecodeError:
        return buf, None
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.flatnonzero((buf & 0xC0) == 0x80)


def runs(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE characters within ascending spans of UTF-8 text, and the span of each, in order.

    Equal runs have equal hashes wherever they lie.
    """
    chars, further = _characters(buf)
    if further is not None:
        begin, stop = (x - np.searchsorted(further, x) for x in (begin, stop))
    windows = np.maximum(stop - begin - SHINGLE + 1, 0)
    n, some = len(chars) - SHINGLE + 1, windows > 0
    if n < 1:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    wide = chars.astype(_U64)
    h, more = wide[:n] * _PLACES[0], np.empty(n, _U64)
    for j in range(1, SHINGLE):
        h += np.multiply(wide[j : n + j], _PLACES[j], out=more)
    edge = np.zeros(len(chars) + 1, np.int8)
    edge[begin[some]] = 1
    edge[(begin + windows)[some]] = -1
    inside = np.cumsum(edge, dtype=np.int8)[:n].view(bool)
    return kernel.mix(h[inside]), np.repeat(np.arange(len(windows)), windows)


def _densified(bins: np.ndarray) -> np.ndarray:
    """Empty bins take the next filled bin's value, to the left or right around the circle, with how far it was."""
    place = np.arange(2 * BINS, dtype=np.int16)
    twice = np.concatenate([bins, bins], axis=1) != _FULL
    left = np.maximum.accumulate(np.where(twice, place, np.int16(-1)), axis=1)[:, BINS:]
    right = np.minimum.accumulate(np.where(twice, place, np.int16(4 * BINS))[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    source = np.where(_LEFT, left, right)
    far = np.abs(source - np.where(_LEFT, place[BINS:], place[:BINS])).astype(np.uint32)
    return np.take_along_axis(bins, (source % BINS).astype(np.int64), axis=1) + np.uint32(0x9E3779B1) * far


def signatures(h: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, BANDS) keys and (n, 2) sketches of n lines that each have hashes, by one-permutation MinHash."""
    bins = np.full(n * BINS, _FULL, np.uint32)
    place = line * BINS + ((h >> _U64(32)) * _U64(BINS) >> _U64(32)).astype(np.int64)
    np.minimum.at(bins, place, (h & _U64(0xFFFFFFFE)).astype(np.uint32))
    bins = bins.reshape(n, BINS)
    some = np.flatnonzero((bins == _FULL).any(axis=1))
    bins[some] = _densified(bins[some])
    values = bins.reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U64), (n, BANDS))
    for r in range(ROWS):
        keys = kernel.mix(keys * _U64(0x9E3779B97F4A7C15) + values[:, :, r])
    two = bins * np.uint32(0x85EBCA6B)  # its first two bits
    planes = [np.packbits(two & np.uint32(1 << k) != 0, axis=1, bitorder="little") for k in (30, 31)]
    return neighbours.band_keys(keys), np.column_stack([np.ascontiguousarray(x).view("<i8") for x in planes])


def _nodes(buf: np.ndarray, offsets: np.ndarray):
    """Node, row, line number, runs, keys and sketch of each line with a word (lower-cased text)."""
    ends, own = _line_ends(buf, offsets)
    start, end, _ = kernel.spans(buf, offsets, kernel.NOT_SPACE)
    if not len(start):
        return None
    line = np.searchsorted(ends, start, "right")
    first_line = kernel.row_bounds(own, len(offsets) - 1)
    new = np.flatnonzero(line[1:] != line[:-1]) + 1
    first, last = np.concatenate([[0], new]), np.append(new, len(line)) - 1
    live = line[first]
    # The text with single spaces: all words, and one byte of white space after each.
    word = kernel.NOT_SPACE[buf]
    stays = word.copy()
    stays[1:] |= word[:-1]
    flat, gone = _SPACED[buf[stays]], np.flatnonzero(~stays)
    begin, stop = (x - np.searchsorted(gone, x) for x in (start[first], end[last]))
    node = kernel.hash_spans(flat, begin, stop)
    h, of = runs(flat, begin, stop)
    size = np.bincount(of, minlength=len(live))
    short = np.flatnonzero(size == 0)
    if len(short):
        h, of = np.concatenate([h, node[short]]), np.concatenate([of, short])
    return node, own[live], live - first_line[own[live]], np.maximum(size, 1), *signatures(h, of, len(live))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row_key", "line", "node", "size", "keys", "sketch"]
    for batch in batches:
        buf, offsets = kernel.utf8(lower(batch.column(2)))
        for a, b in kernel.chunks(offsets, _SIGNED_BYTES):
            got = _nodes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if got is None:
                continue
            node, row, number, size, keys, sketch = got
            # Of equal lines of one document only the first goes on.
            order = np.lexsort((number, node, row))
            same = np.zeros(len(order), bool)
            same[1:] = (node[order][1:] == node[order][:-1]) & (row[order][1:] == row[order][:-1])
            use = np.sort(order[~same])
            own = pa.array(a + row[use])
            columns = [number[use], kernel.signed(node[use]), size[use]]
            lists = [pa.ListArray.from_arrays(np.arange(len(use) + 1, dtype=np.int32) * x.shape[1], x[use].ravel()) for x in (keys, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x) for x in columns), *lists], names)


def line_sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of lines with single spaces, and the line of each, for exact verification."""
    buf, at = kernel.utf8(lines)
    h, own = runs(buf, at[:-1], at[1:])
    short = np.flatnonzero(np.bincount(own, minlength=len(at) - 1) == 0)
    if len(short):
        h, own = np.concatenate([h, kernel.hash_spans(buf, at[short], at[short + 1])]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return h, own


def _wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of documents: (text, wanted: list of (line, node))."""
    for batch in batches:
        texts = lower(batch.column(0)).to_pylist()
        nodes, found, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "content"])

        for text, wanted in zip(texts, batch.column(1).to_pylist(), strict=True):
            lines = text.split("\n")
            for w in wanted:
                nodes.append(w["node"])
                found.append(b" ".join(lines[w["line"]].encode("utf-8", "replace").split()))  # bytes are split at ASCII white space alone, as in _nodes
                size += len(found[-1])
            if size > 1 << 24:
                yield out()
                nodes, found, size = [], [], 0
        yield out()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, text, keep) without the lines that do not stay."""
    for batch in batches:
        texts, removed, count = [], [], []
        for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            kept = set(keep or ())
            gone = [k for k, x in enumerate(lines) if k not in kept and x.strip(" \t\n\v\f\r")]
            if gone:
                out = set(gone)
                text = "\n".join(x for k, x in enumerate(lines) if k not in out)
            texts.append(text)
            count.append(len(lines))
            removed.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.list_(pa.int64()))], ["row", "text", "n_lines", "removed_lines"])


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, keep): the numbers of the lines that stay, for rows with any; docs: doc_id, row_key, text."""
    lines = docs.select("doc_id", "row_key", "text").mapInArrow(_signed, "doc_id long, row_key long, line long, node long, size long, keys array<long>, sketch array<long>")
    # Equal lines have equal keys, so they travel with the least place.
    nodes = lines.groupBy("node").agg(F.min(F.struct("doc_id", "row_key", "line", "size", "keys", "sketch")).alias("at"))
    nodes = written(nodes.select("node", "at.*"), "lines")
    memberships = neighbours.memberships(nodes, threshold)
    members = written(memberships, "members")
    drop(memberships.reads)
    # Keys and sketches, most of the table, have done their work.
    placed = written(nodes.select("node", "doc_id", "row_key", "line", "size"), "places")
    drop(nodes.written_to)

    wanted = members.select("node").distinct().join(placed.drop("size"), "node")
    wanted = wanted.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("r")).agg(F.collect_list(F.struct("line", "node")).alias("wanted"))
    found = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["d"]) & (docs["row_key"] == wanted["r"]))
    sets = found.select("text", "wanted").mapInArrow(_wanted_lines, "node long, content binary")
    none = F.array().cast("array<long>").alias("keys")  # how often a pair meets does not matter here, so no keys are moved
    described = members.join(placed.select("node", none, "size", F.lit(1).cast("long").alias("copies")), "node")
    links = written(neighbours.verified(described.join(sets, "node"), threshold, line_sets).select(F.col("node").alias("a"), F.col("reaches").alias("b")), "links")
    drop(members.written_to)
    roots = connected_components(links)
    drop(links.written_to)

    rooted = placed.drop("size").join(roots, "node", "left")
    alone = rooted.filter("root is null").select("doc_id", "row_key", "line")
    grouped = rooted.filter("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("at")).select("at.*")
    kept = written(alone.unionByName(grouped).groupBy("doc_id", "row_key").agg(F.collect_list("line").alias("keep")), "kept")
    drop(placed.written_to)
    return kept


def _apply(docs: DataFrame, threshold: float) -> DataFrame:
    """(row, text, n_lines, removed_lines); row: the other columns of ``docs``."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("row")
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    keyed = docs.select(row, doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("row_key"))
    keep = kept_lines(keyed, threshold).select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "keep")
    joined = keyed.join(keep.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(keep["d"]) & (keyed["row_key"] == keep["r"]), "left").select("row", "text", "keep")
    kind = T.StructType([keyed.schema["row"], *T.StructType.fromDDL("text string, n_lines long, removed_lines array<long>")])
    return joined.mapInArrow(_applied, kind)


def _columns(docs: DataFrame, without: tuple[str, ...] = ()) -> list:
    return [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in without]


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with text as it is left, n_lines and removed_lines (numbers from 0)."""
    return _apply(docs, threshold).select(*_columns(docs, ("n_lines", "removed_lines")), "n_lines", "removed_lines")


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with text as it is left; a column n_chars follows the text where that has changed.

    A row that has lost all its lines goes: each of them stands in another document.
    """
    columns = _columns(docs)
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        changed = F.when(F.size("removed_lines") > 0, F.length("text")).otherwise(F.col("row")["n_chars"])
        columns[at] = changed.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    lost_all = (F.size("removed_lines") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return _apply(docs, threshold).filter(~lost_all).select(*columns)
