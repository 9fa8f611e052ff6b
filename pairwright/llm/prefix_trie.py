"""The trie of conversation prefixes, in node tables under a minimal perfect hash.

Conversations are rebuilt (the first turns from another one), and each prefix of a rebuilt one
is a digest of 128 bits.  Equal prefixes of all conversations are one node, counted by one shuffle.
Figures of subtrees come from shards.  A shard has whole paths of some conversations; a node's own
figures count in the one shard that has the path of its smallest member, where all its ancestors
stand too.  There the distinct digests get slots by a minimal perfect hash, each checked against the digest
in its slot; figures are scattered into flat arrays and added along an array of parent slots, the
deepest first.  Sums of the same node in several shards are added by a shuffle, so a prefix that all
conversations share meets no task as more than a row a shard.

Result of ``prefix_nodes``, one row for each node: conv_id (smallest member), depth,
parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

Nulls: a null role or text counts as empty, a null turn stands first; rows with a null conv_id
belong to no conversation.  Turns of equal number stand in the order of a hash of role and text, so
the order of rows says nothing; repeated rows are turns each.  Texts are read whole.  A task holds
the digests of the conversations that are rebuilt from one (twenty, for ids from 0), and of one
conversation whatever its length, but no text.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_spread
from .kernel import mix, mix_int
from .store import drop, written
from .vector_near import whole_groups

#: A conversation takes its first turns from the one whose id is the next lower multiple of this.
FAMILY = 20
#: Turns taken are the crc32 of the id modulo this.
MOST_TAKEN = 4
#: Rows of a shard, and ids of a piece of a list of members.
SHARD_ROWS = 200_000
PIECE_IDS = 10_000

U64 = np.uint64
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_PATH = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, words long, ends long"


def _digests(terms: np.ndarray, base: np.uint64, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Digests of all prefixes: sums of terms times powers of an odd base, mixed with the depth.

    ``place`` is a term's place in its conversation, ``first`` the position of that conversation's first term.
    """
    powers = np.full(int(place.max(initial=0)) + 2, base)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(terms) * powers[place + 1], dtype=U64)])
    return mix(sums[1:] - sums[first] + mix(place.astype(U64) + U64(1)))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PATH`` for all prefixes, the empty one included, of conversations that come by family, the one that lends first."""
    for table in whole_groups(batches, 1):
        family, conv, taken, words = (table.column(c).to_numpy() for c in ("family", "conv_id", "taken", "words"))
        terms = [table.column(c).to_numpy().view(U64) for c in ("t1", "t2")]
        start = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (family[1:] != family[:-1])]))
        size = np.diff(np.append(start, len(conv)))
        ids, home, taken = conv[start], family[start], taken[start]
        head = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        lender = np.repeat(head, np.diff(np.append(head, len(home))))
        lent = np.where(ids[lender] == home, np.minimum(taken, size[lender]), 0)
        length = lent + np.maximum(size - taken, 0)
        first = np.cumsum(length) - length
        own = np.repeat(np.arange(len(ids)), length)
        place = np.arange(len(own)) - first[own]
        source = np.where(place < lent[own], start[lender][own] + place, start[own] + taken[own] + place - lent[own])
        digests = [_digests(t[source], base, place, first[own]).view(np.int64) for t, base in zip(terms, _BASES, strict=True)]
        parents = [np.where(place > 0, np.concatenate([[0], d[:-1]])[: len(d)], 0) for d in digests]
        none = np.zeros(len(ids), np.int64)
        columns = [
            np.concatenate([ids, ids[own]]), np.concatenate([none, place + 1]), *(np.concatenate([none, x]) for x in (*digests, *parents, words[source])),
            np.concatenate([length == 0, place + 1 == length[own]]).astype(np.int64),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _PATH.split(", ")])


class PerfectSlots:
    """Slots 0 to n - 1 of n distinct pairs of numbers, by levels of bit arrays.

    On each level the keys that meet no other stay; the others go to the next.  A slot is the number of taken
    bits before its own.  The keys are kept by slot, so that every look-up is checked.
    """

    ROOM = 2

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # taken bits, and slots before each
        left_a, left_b, before = a.view(U64), b.view(U64), 0
        while len(left_a):
            at = self._at(left_a, left_b, len(self.levels), self.ROOM * len(left_a))
            alone = np.bincount(at, minlength=self.ROOM * len(left_a)) == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
            again = ~alone[at]
            left_a, left_b = left_a[again], left_b[again]
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
        self.n = before
        self.a, self.b = np.zeros(before, np.int64), np.zeros(before, np.int64)
        slot = self._find(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + U64(mix_int(level + 1)) ^ mix(b + U64(level))) % U64(size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(a), -1), np.arange(len(a))
        for level, (taken, before) in enumerate(self.levels):
            at = self._at(a[left].view(U64), b[left].view(U64), level, len(taken))
            hit = taken[at]
            slot[left[hit]] = before[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return slot

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of keys that were given; an other key is an error."""
        slot = self._find(a, b)
        if (slot < 0).any() or (self.a[slot] != a).any() or (self.b[slot] != b).any():
            raise ValueError("a digest has no slot")
        return slot


def _subtrees(conv: np.ndarray, depth: np.ndarray, d: tuple, p: tuple, n_convs: np.ndarray, n_ends: np.ndarray, words: np.ndarray, is_node: np.ndarray) -> list[np.ndarray]:
    """(d1, d2, n_children, n_leaves, saved_tokens): what the nodes of a shard give to themselves and to their ancestors."""
    owns = np.isin(conv, conv[is_node])
    path = np.flatnonzero(owns & ~is_node)
    _, first = np.unique(np.stack([d[0][path], d[1][path]]), axis=1, return_index=True)
    path = path[first]
    slots = PerfectSlots(d[0][path], d[1][path])
    at = slots(d[0][path], d[1][path])
    level, up = np.zeros(slots.n, np.int64), np.full(slots.n, -1)
    level[at] = depth[path]
    inner = depth[path] > 0
    up[at[inner]] = slots(p[0][path[inner]], p[1][path[inner]])

    children, leaves, saved = (np.zeros(slots.n, np.int64) for _ in range(3))
    node = np.flatnonzero(is_node)
    own = slots(d[0][node], d[1][node])
    leaves[own] = n_convs[node] == n_ends[node]
    saved[own] = (n_convs[node] - 1) * words[node]
    np.add.at(children, up[own[level[own] > 0]], 1)
    order = np.argsort(-level, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        if level[same[0]] > 0:
            np.add.at(leaves, up[same], leaves[same])
            np.add.at(saved, up[same], saved[same])
    live = (children > 0) | (leaves > 0) | (saved > 0)
    return [x[live] for x in (slots.a, slots.b, children, leaves, saved)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of subtrees, of shards of whole conversations."""
    held: list[pa.Table] = []

    def out() -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        held.clear()
        c = {name: t.column(name).to_numpy() for name in t.column_names}
        found = _subtrees(c["conv_id"], c["depth"], (c["d1"], c["d2"]), (c["p1"], c["p2"]), c["n_convs"], c["n_ends"], c["words"], c["is_node"] > 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["d1", "d2", "n_children", "n_leaves", "saved_tokens"])

    for table in whole_groups(batches, 1):
        held.append(table)
        if sum(t.num_rows for t in held) >= SHARD_ROWS:
            yield out()
    if held:
        yield out()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, first, ids): ids of a node as text, joined by commas, in pieces of bounded length; rows come in order."""
    for batch in batches:
        d1, d2, conv = (batch.column(k).to_numpy() for k in range(3))
        new = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])) if len(d1) else np.zeros(0, int)
        cuts = np.union1d(new, np.arange(0, len(d1), PIECE_IDS)).astype(int)
        ids = [",".join(map(str, part.tolist())) for part in np.split(conv, cuts[1:])] if len(cuts) else []
        yield pa.RecordBatch.from_arrays([pa.array(d1[cuts]), pa.array(d2[cuts]), pa.array(conv[cuts]), pa.array(ids, pa.string())], ["d1", "d2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, ends_sha256) of nodes whose pieces come in order; a piece is held at a time."""
    current, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int64()), pa.array([current[1]], pa.int64()), pa.array([state.hexdigest()])], ["d1", "d2", "ends_sha256"])

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (d1, d2) != current:
                if current is not None:
                    done.append(out())
                current, state = (d1, d2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if current is not None:
        yield out()


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text); see the module for the columns."""
    conv = turns["conv_id"].cast("long")
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), turns["turn"].alias("turn"), (F.crc32(conv.cast("string")) % MOST_TAKEN).cast("long").alias("taken"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    lends = (F.col("conv_id") != F.col("family")).alias("borrows")
    rows = rows.repartition("family").sortWithinPartitions("family", lends, "conv_id", F.col("turn").asc_nulls_first(), "t1", "t2")
    paths = written(rows.drop("turn").mapInArrow(_rebuilt, _PATH), "paths")

    # A digest names one prefix: parent, depth and last text of all its rows must agree.
    agree = F.lit(True)
    for c in ("depth", "p1", "p2", "words"):
        agree &= F.min(c) == F.max(c)
    first = F.when(agree, F.min("conv_id")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    nodes = paths.groupBy("d1", "d2").agg(
        first.alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends")
    )
    nodes = written(nodes, "nodes")

    none = F.lit(0).cast("long")
    columns = ["conv_id", "depth", "d1", "d2", "p1", "p2", "words"]
    both = paths.select(*columns, none.alias("n_convs"), none.alias("n_ends"), none.alias("is_node")).unionByName(nodes.select(*columns, "n_convs", "n_ends", (none + 1).alias("is_node")))
    sums = both.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_shards, "d1 long, d2 long, n_children long, n_leaves long, saved_tokens long")
    sums = sums.groupBy("d1", "d2").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = paths.filter("ends = 1").select("d1", "d2", "conv_id").repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    pieces = ends.mapInArrow(_pieces, "d1 long, d2 long, first long, ids string")
    ends = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_hashed, "d1 long, d2 long, ends_sha256 string")

    zero = lambda c: F.coalesce(c, none).alias(c)
    full = nodes.join(sums, ["d1", "d2"], "left").join(ends, ["d1", "d2"], "left").select(
        F.struct("d1", "d2").alias("own"), F.struct(F.col("p1").alias("d1"), F.col("p2").alias("d2")).alias("parent"), "conv_id", "depth", "n_convs", zero("n_children"), zero("n_leaves"), zero("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    full = written(full, "trie")
    drop(paths.written_to)
    drop(nodes.written_to)
    parents = full.filter("n_children > 0").select(F.col("own").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_spread(full.filter("depth > 0"), parents, "parent", "n")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*names).unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names))
