"""Candidate buckets of a banded signature table and their exact verification in blocks.

The tables here have one row for each *distinct* set, so copies weigh nothing: a node, its
number of copies, its size and one key for each band (``keys``: array of longs with the band
in the top byte).  Buckets hold nodes that share a key; buckets with the very same nodes are
one.  A large bucket is cut into chunks, and each pair of chunks is a block of its own, so a
group of any size is spread over tasks and no list of its pairs is ever made: a block gives
one row a node, with the number of its partners and the least node it reaches there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import written

#: Nodes, and hashes of their sets, that a chunk of a bucket has on average at most.
CHUNK_NODES = 256
CHUNK_HASHES = 1 << 18
_BAND_BITS = 56
#: Nodes for each bucket of keys, and pairs of a key and a node that are looked at together.
BUCKET_NODES = 1 << 16
MET_PAIRS = 1 << 18
#: MinHash values of which a sketch has two bits.
SKETCH_VALUES = 60


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values each that meet pairs of similarity ``threshold`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_keys(keys: np.ndarray) -> np.ndarray:
    """(rows, bands) signed keys with the band in the top byte."""
    band = np.arange(keys.shape[1], dtype=np.uint64) << np.uint64(_BAND_BITS)
    return ((keys >> np.uint64(64 - _BAND_BITS)) | band).view(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, keys) as pairs of a key and a node, dealt by their key: (bucket, keys, nodes), the pairs of a bucket as numbers in one row a batch."""
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        key, node = batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), size)
        if not len(key):
            continue
        bucket = (key & ((1 << _BAND_BITS) - 1)) % buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        ends = pa.py_buffer(np.append(first, len(key)).astype(np.int32) * np.int32(8))
        held = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x[order])]) for x in (key, node)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *held], ["bucket", "keys", "nodes"])


class _Met:
    """Keys that have come so far, in order, with the first node of each and whether an other node has come."""

    def __init__(self) -> None:
        self.key, self.node, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, of these and of earlier ones, of which it is known only now that an other node has the key."""
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run, own = np.diff(np.append(first, len(key))), key[first]
        at = np.searchsorted(self.key, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == own[inside]
        goes = np.repeat(known | (run > 1), run)
        before = at[known]
        before = before[~self.met[before]]
        out = np.concatenate([self.key[before], key[goes]]), np.concatenate([self.node[before], node[goes]])
        self.met[before] = True
        new = ~known
        self.key, self.node, self.met = (np.insert(x, at[new], y[new]) for x, y in ((self.key, own), (self.node, node[first]), (self.met, run > 1)))
        return out


def _met_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (key, node) whose key an other node has, from rows (bucket, keys, nodes) sorted by bucket.

    A task holds the different keys of one bucket and at most ``MET_PAIRS`` pairs and one row besides.
    """
    held: list[list[np.ndarray]] = []
    bucket, met, waiting = None, _Met(), 0

    def taken() -> Iterator[pa.RecordBatch]:
        found = met.take(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        for k in range(0, len(found[0]), MET_PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + MET_PAIRS]) for x in found], ["key", "node"])

    for batch in batches:
        for k in range(batch.num_rows):
            if (here := batch.column(0)[k].as_py()) != bucket:
                if held:
                    yield from taken()
                bucket, met, waiting = here, _Met(), 0
            held.append([np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in (1, 2)])
            waiting += len(held[-1][0])
            if waiting >= MET_PAIRS:
                yield from taken()
                waiting = 0
    if held:
        yield from taken()


def most_apart(threshold: float) -> int:
    """Values of a sketch in which two nodes may differ: five deviations more than pairs at the threshold do."""
    p = 0.75 * (1 - threshold)
    return math.ceil(SKETCH_VALUES * p + 5 * math.sqrt(SKETCH_VALUES * p * (1 - p)))


def memberships(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, key, i, j): the blocks that each node goes to; nodes: node, size, keys and, if there is one, sketch.

    Buckets of two nodes whose sizes rule out the threshold have no block.  A sketch, an array of
    two longs, has two bits of each of ``SKETCH_VALUES`` MinHash values; two nodes alone in a bucket
    must not differ in more of them than ``most_apart`` allows.
    """
    buckets = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // BUCKET_NODES))
    dealt = nodes.select("node", "keys").mapInArrow(partial(_dealt, buckets=buckets), "bucket int, keys binary, nodes binary")
    # Most keys have one node; what goes on is small.
    pairs = written(dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_met_keys, "key long, node long"), "shared")
    about = [c for c in ("size", "sketch") if c in nodes.columns]
    bits = [F.bit_xor(F.get("sketch", F.lit(k))).alias(f"bits{k}") for k in range(2 * ("sketch" in about))]
    mark = F.bit_xor(F.xxhash64("node"))
    buckets = pairs.join(nodes.select("node", *about), "node").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("most"), mark.alias("mark"), *bits
    )
    alike = F.col("least") >= threshold * F.col("most") - 1e-9
    if bits:
        alike &= F.bit_count(F.col("bits0").bitwiseOR(F.col("bits1"))) <= most_apart(threshold)
    buckets = buckets.filter((F.col("n") > 2) | alike).groupBy("n", "total", "mark").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK_NODES), F.ceil(F.col("total") / CHUNK_HASHES))
    parts = F.least(parts, F.col("n")).cast("int")
    members = pairs.join(buckets.select("key", parts.alias("parts")), "key")
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    spread = members.select("node", "key", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    out = spread.select("node", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    out.reads = pairs.written_to  # type: ignore[attr-defined]
    return out


def shared_counts(h: np.ndarray, own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each two of m sets have in common, and how many each has; h: hashes of the sets, in any order and with repeats, own: the set of each."""
    # The set stands in the last bits of the hash, so that plain sorting brings together what sets share and what one has twice.
    bits = np.uint64(max(1, (m - 1).bit_length()))
    last = (np.uint64(1) << bits) - np.uint64(1)
    mark = np.sort((h & ~last) | own.astype(np.uint64))
    fresh = np.ones(len(mark), bool)
    fresh[1:] = mark[1:] != mark[:-1]
    mark = mark[fresh]
    own = (mark & last).astype(np.int64)
    mark >>= bits
    sizes = np.bincount(own, minlength=m)
    first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    run = np.diff(np.append(first, len(mark)))
    places = [np.zeros(0, np.int64)]
    for length in range(2, 9):
        at = first[run == length]
        each = [own[at + k] for k in range(length)] if len(at) else []
        places += [x * m + y for k, x in enumerate(each) for y in each[k + 1 :]]
    counts = np.bincount(np.concatenate(places), minlength=m * m).reshape(m, m)
    begin, run = first[run > 8], run[run > 8]
    for k in range(0, len(begin), 4096):
        b, r = begin[k : k + 4096], run[k : k + 4096]
        incidence = np.zeros((m, len(b)), np.float32)
        at = np.repeat(b - np.concatenate([[0], np.cumsum(r)[:-1]]), r) + np.arange(r.sum())
        incidence[own[at], np.repeat(np.arange(len(b)), r)] = 1
        counts += np.triu((incidence @ incidence.T).astype(np.int64), 1)  # counts below 2**24 are exact
    return counts + counts.T, sizes


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of m members is linked to, over any number of links."""
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _block(key: int, i: int, j: int, rows: pa.Table, threshold: float, set_of: Callable) -> list[np.ndarray]:
    """Links of one block: node, partner texts, partner documents, least node reached."""
    rows = rows.sort_by("node")  # so that the least member is the least node
    node, copies, chunk = (rows.column(c).to_numpy() for c in ("node", "copies", "chunk"))
    shared, size = shared_counts(*set_of(rows.column("content").combine_chunks()), len(node))
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= chunk[:, None] != chunk[None, :]
    for earlier in range(min(key >> _BAND_BITS, keys.shape[1])):  # a pair counts in the first band that it shares
        same = keys[:, earlier]
        linked &= same[:, None] != same[None, :]
    a, b = np.nonzero(np.triu(linked))
    live = linked.any(axis=1)
    root = _roots(len(node), a, b)
    return [node[live], linked.sum(axis=1)[live], (linked @ copies)[live], node[root][live]]


def hashes(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are the content themselves, and the row of each."""
    buf, offsets = kernel.utf8(content)
    size = np.diff(offsets) // 8
    return np.frombuffer(buf.tobytes(), np.uint64), np.repeat(np.arange(len(size)), size)


#: Members of a block that is verified together with others, and hashes that are taken at a time (few, to stay in the cache).
SMALL_BLOCK = 12
BATCH_HASHES = 1 << 18


def _small_blocks(rows: pa.Table, threshold: float, set_of: Callable) -> list[np.ndarray]:
    """Links of many blocks of at most SMALL_BLOCK rows each, whose rows stand together, in one pass."""
    key, i, j, node, chunk, copies = (rows.column(c).to_numpy() for c in ("key", "i", "j", "node", "chunk", "copies"))
    m = len(key)
    new = np.ones(m, bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, m))
    place = np.arange(m) - first[group]
    h, own = set_of(rows.column("content").combine_chunks())
    # One number has the block in its first bits, the hash (40 bits or more of it) and the place in the block in the
    # last four, so that plain sorting brings together what members share and what one has twice.
    bits = np.uint64(len(first).bit_length())
    head = (group.astype(np.uint64) << (np.uint64(64) - bits)) | place.astype(np.uint64)
    mark = np.sort(((h >> bits) & ~np.uint64(15)) | head[own])
    fresh = np.ones(len(mark), bool)
    fresh[1:] = mark[1:] != mark[:-1]
    mark = mark[fresh]
    own = first[(mark >> (np.uint64(64) - bits)).astype(np.int64)] + (mark & np.uint64(15)).astype(np.int64)
    mark >>= np.uint64(4)
    sizes = np.bincount(own, minlength=m)
    begin = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    run = np.diff(np.append(begin, len(mark)))
    square = size * size
    base = np.concatenate([[0], np.cumsum(square)])
    spots = [np.zeros(0, np.int64)]
    line, column = (base[group] + place * size[group])[own], place[own]
    for length in range(2, SMALL_BLOCK + 1):
        at = begin[run == length]
        if len(at):
            columns = [column[at + k] for k in range(length)]
            spots += [x + y for k in range(length - 1) for x in [line[at + k]] for y in columns[k + 1 :]]
    shared = np.bincount(np.concatenate(spots), minlength=base[-1])
    hit = np.flatnonzero(shared)
    g = np.searchsorted(base, hit, "right") - 1
    a, b = first[g] + (hit - base[g]) // size[g], first[g] + (hit - base[g]) % size[g]
    both = shared[hit]
    use = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    use &= (i[a] == j[a]) | (chunk[a] != chunk[b])
    a, b = a[use], b[use]
    keys = rows.column("keys").combine_chunks()
    keys = keys.flatten().to_numpy().reshape(m, -1)
    earlier = np.arange(keys.shape[1]) < (key[a] >> _BAND_BITS)[:, None]
    use = ~((keys[a] == keys[b]) & earlier).any(axis=1)
    a, b = a[use], b[use]
    texts = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
    documents = np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
    root = _roots(m, a, b)
    live = np.flatnonzero(texts)
    return [node[live], texts[live], documents[live].astype(np.int64), node[root[live]]]


def verified(blocks: DataFrame, threshold: float, set_of: Callable = hashes) -> DataFrame:
    """(node, texts, documents, reaches) by block; blocks: memberships with copies, keys and content.

    ``set_of`` gives the hashes of an array of contents and the row of each, rows in order; by
    default the contents are hashes.  With empty keys a pair counts in each band that it shares, so
    only what nodes reach can be used.
    """
    columns = ["key", "i", "j", "node", "chunk", "copies", "keys", "content", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the block that further batches may go on with
        small: list[pa.RecordBatch] = []
        current, last = None, None

        def out(x: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in x], ["node", "texts", "documents", "reaches"])

        def close() -> Iterator[pa.RecordBatch]:
            n = sum(x.num_rows for x in held)
            if 1 < n <= SMALL_BLOCK:
                small.extend(held)
            elif n > 1:
                yield out(_block(*current, pa.Table.from_batches(held), threshold, set_of))
            held.clear()

        def close_small() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(small).combine_chunks()
            small.clear()
            key, i, j, size = (rows.column(k).to_numpy() for k in ("key", "i", "j", "size"))
            first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1])
            part = np.cumsum(np.add.reduceat(size, first)) // BATCH_HASHES
            cuts = first[1:][part[1:] != part[:-1]]
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                yield out(_small_blocks(rows.slice(a, b - a), threshold, set_of))

        for table in batches:
            key, i, j, node = (table.column(k).to_numpy() for k in range(4))
            if not len(key):
                continue
            # Repeated documents bring a node more than once, one after the other.
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (node[1:] != node[:-1])
            fresh[0] = (key[0], i[0], j[0], node[0]) != last
            last = (key[-1], i[-1], j[-1], node[-1])
            if not fresh.all():
                table = table.filter(pa.array(fresh))
                key, i, j = key[fresh], i[fresh], j[fresh]
                if not len(key):
                    continue
            at = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(key)]])
            begun = int((int(key[0]), int(i[0]), int(j[0])) == current)
            if begun:
                held.append(table.slice(0, at[1]))
            if begun < len(at) - 1:
                yield from close()
                # Blocks that lie in this batch as a whole; small ones go on together.
                size = np.diff(at)
                whole = np.zeros(len(size), bool)
                whole[begun:-1] = True
                if (few := whole & (size > 1) & (size <= SMALL_BLOCK)).any():
                    small.append(table.filter(pa.array(np.repeat(few, size))))
                for k in np.flatnonzero(whole & (size > SMALL_BLOCK)):
                    a = at[k]
                    yield out(_block(int(key[a]), int(i[a]), int(j[a]), pa.Table.from_batches([table.slice(a, size[k])]), threshold, set_of))
                a = at[-2]
                current = (int(key[a]), int(i[a]), int(j[a]))
                held.append(table.slice(a))
            if small:
                yield from close_small()
        if held:
            yield from close()
        if small:
            yield from close_small()

    dealt = blocks.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "node long, texts long, documents long, reaches long")


def sorted_sets(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the n + 1 places at which rows begin."""
    h, rows = kernel.unique_in_rows(h, rows)
    return h, kernel.row_bounds(rows, n)
