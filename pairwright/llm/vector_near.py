"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Equal vectors of a label are one node and take part once.  A node is projected on a great many
directions: in each of several groups these are all scaled sums of one signed axis from each of
``k`` random rotations, so ``k`` products give the values on ``(2d)**k`` of them.  A projection
holds the nodes for which it is among their ``PLACES`` largest of the group, sorted by value; a
node's window reaches ``WINDOW`` deviations of a pair at the threshold to either side.  Pairs that
meet in a window are counted over ``COUNTED`` more projections, each with a window centred on
the node, and those with the calibrated count or more are verified by their cosine.

Groups come from the recall of simulated pairs exactly at the threshold, the least count from
the chance that such a pair leaves a window.  ``k`` grows with the logarithm of the nodes, so
what meets in a projection by chance stays a few a node.

A projection that holds many nodes is cut into chunks and each two chunks are a block of their
own, so no group meets in one task and no pair is ever a row: a block gives, for each of its
nodes, the number of its partners and the least node that it reaches.  Vectors travel only to
blocks in which a pair has passed the count.

Result of ``near_vectors``, one row for each row of the table: vec_id, n_links (other vectors
linked directly), component_id (the least vec_id that links lead to) and kept.

A vector that is null, empty or zero, or holds null or non-finite components, and one without
a label links with nothing; so do vectors of different lengths.  Rows with a null vec_id take
part, with a null vec_id in the result and never kept; a component of such rows alone has a null
component_id.  Repeated rows count as vectors each.  Ties at the threshold are links.  An empty
table gives no rows.  Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_spread
from .kernel import mix, mix_int
from .neighbours import _roots
from .store import drop, written

THRESHOLD = 0.98
#: Chance that a pair at the threshold meets in some projection, and that its count passes.
RECALL = 0.9999
#: Projections of a group that hold a node, and values of each rotation that are tried for them.
PLACES = 4
TRIED = 3
MOST_ROTATIONS = 6
#: Projections over which collisions are counted.
COUNTED = 24
#: Half the width of a window, in deviations of a pair at the threshold.
WINDOW = 4.0
#: Nodes of a chunk, on average, and pairs that are compared at a time.
CHUNK_NODES = 2048
PAIRS = 1 << 16
_SIMULATED = 3000
_NO_KEY = (1 << 63) - 1


def rotations_for(n: int, d: int) -> int:
    """Rotations summed into a direction, so that a group has as many directions as there are nodes."""
    return min(MOST_ROTATIONS, max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * max(d, 1)))))


@lru_cache(maxsize=64)
def _rotation(d: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([d, seed]).standard_normal((d, d)))[0]


def _placed(x: np.ndarray, group: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): the projections of one group that hold each unit vector, by number, and its values there."""
    n, d = x.shape
    best, code = np.zeros((n, 1)), np.zeros((n, 1), np.uint64)
    tried = min(TRIED, 2 * d)
    for r in range(k):
        h = x @ _rotation(d, 1 + group * MOST_ROTATIONS + r)
        h = np.concatenate([h, -h], axis=1)
        at = np.argpartition(-h, tried - 1, axis=1)[:, :tried]
        best = (best[:, :, None] + np.take_along_axis(h, at, 1)[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * np.uint64(2 * d) + at[:, None, :].astype(np.uint64)).reshape(n, -1)
    places = min(PLACES, best.shape[1])
    at = np.argpartition(-best, places - 1, axis=1)[:, :places]
    return np.take_along_axis(code, at, 1), np.take_along_axis(best, at, 1) / math.sqrt(k)


@lru_cache(maxsize=64)
def groups_for(d: int, k: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Groups after which a pair exactly at the threshold has met in a window with chance ``recall``.

    Measured for one group on simulated pairs; groups are independent.
    """
    g = np.random.default_rng([d, k, 5])
    x, z = g.standard_normal((2, _SIMULATED, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.maximum(np.linalg.norm(z, axis=1)[:, None], 1e-300)  # of one dimension nothing is left
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * z
    y /= np.linalg.norm(y, axis=1)[:, None]
    (a, ha), (b, hb) = _placed(x, 0, k), _placed(y, 0, k)
    near = np.abs(ha[:, :, None] - hb[:, None, :]) <= window(d, threshold)
    met = ((a[:, :, None] == b[:, None, :]) & near).any(axis=(1, 2)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1 - met, 1e-9))))


def window(d: int, threshold: float = THRESHOLD) -> float:
    return WINDOW * math.sqrt((2 - 2 * threshold) / d)


def least_count(counted: int, recall: float = RECALL) -> int:
    """Collisions that a pair at the threshold has with chance ``recall`` or more, of ``counted`` windows."""
    out = math.erfc(WINDOW / math.sqrt(2))
    missed, most = (1 - out) ** counted, 0
    while missed < recall and most < counted:
        most += 1
        missed += math.comb(counted, most) * out**most * (1 - out) ** (counted - most)
    return counted - most


def _levels(d: int) -> float:
    """Steps of a counted value for each unit of it: a byte spans six deviations to either side."""
    return 127 * max(1.0, math.sqrt(d) / 6)


def unit(vectors: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, float)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the n + 1 places at which rows begin."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _padded(column: pa.Array, fill: float) -> np.ndarray:
    values, offsets = _lists(column)
    sizes = np.diff(offsets)
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, np.int64 if isinstance(fill, int) else float)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix): the vectors of each length."""
    values, offsets = _lists(column)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[(offsets[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)


def _places(n_nodes: int, threshold: float):
    """Of (node, salt, v): node, its projections as keys, its values there and on the counted ones, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for rows, matrix in _by_length(batch.column(2)):
                d = matrix.shape[1]
                k = rotations_for(n_nodes, d)
                step = max(1, (1 << 21) // (d * (1 + TRIED**k // 8)))
                for s in range(0, len(rows), step):
                    own, x = rows[s : s + step], unit(matrix[s : s + step])
                    keys, values = [], []
                    for g in range(groups_for(d, k, threshold)):
                        code, h = _placed(x, g, k)
                        code = mix(code + np.uint64(mix_int((d << 32) + g)))
                        keys.append(mix(code ^ salt[own][:, None]).view(np.int64))
                        values.append(h.astype(np.float32))
                    counted = x @ _rotation(d, 0)[:, : min(COUNTED, d)]
                    code = np.clip(np.rint(counted * _levels(d)), -127, 127).astype(np.int8)
                    places = np.arange(len(own) + 1, dtype=np.int32) * sum(key.shape[1] for key in keys)
                    flat = lambda parts: pa.array(np.concatenate(parts, axis=1).ravel())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own]), pa.ListArray.from_arrays(places, flat(keys)), pa.ListArray.from_arrays(places, flat(values)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.full(len(own), d, np.int32))],
                        ["node", "keys", "values", "code", "d"],
                    )

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables that end where the first ``columns`` change; rows of a group stand together and are held until the next begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(columns)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held:
            new[0] = any(held[-1].column(c)[-1].as_py() != k[0] for c, k in enumerate(keys))
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            whole = [*held, batch.slice(0, last)] if last else held
            if whole:
                yield pa.Table.from_batches(whole).combine_chunks()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _colliding(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a, b) of one block that pass the count.

    Rows stand sorted by their value on the projection; the rows s places apart are compared all at
    once, for s = 1, 2, ... until no window reaches so far.
    """
    key, i, j, chunk = (table.column(c).to_numpy() for c in ("key", "i", "j", "chunk"))
    value, d = table.column("value").to_numpy().astype(float), table.column("d").to_numpy()
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    block = np.cumsum(new) - 1
    raw = table.column("code").combine_chunks()
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
    width = np.diff(offsets)
    code = np.zeros((n, int(width.max(initial=0))), np.int16)
    data = np.frombuffer(raw.buffers()[2], np.int8) if raw.buffers()[2] is not None else np.zeros(0, np.int8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        code[rows, :w] = data[(offsets[rows][:, None] + np.arange(w)).ravel()].reshape(len(rows), w)
    kinds = {int(x): (window(int(x), threshold), math.ceil(window(int(x), threshold) * _levels(int(x))) + 1, least_count(min(COUNTED, int(x)))) for x in np.unique(d)}
    reach, steps, least = (np.array([kinds[int(x)][c] for x in d]) for c in range(3))
    extra = code.shape[1] - width  # places that hold nothing collide always
    first = np.arange(n)
    for s in range(1, n):
        first = first[first < n - s]
        first = first[(block[first] == block[first + s])]
        first = first[value[first + s] - value[first] <= reach[first] + 1e-6]
        if not len(first):
            return
        for k in range(0, len(first), PAIRS):
            a = first[k : k + PAIRS]
            b = a + s
            near = (np.abs(code[a] - code[b]) <= steps[a][:, None]).sum(axis=1) - extra[a] >= least[a]
            near &= (i[a] == j[a]) | (chunk[a] != chunk[b])
            if near.any():
                yield a[near], b[near]


def _passed(threshold: float):
    """The rows of blocks that have passed the count with a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            live = np.zeros(table.num_rows, bool)
            for a, b in _colliding(table, threshold):
                live[a] = live[b] = True
            yield from table.filter(pa.array(live)).to_batches()

    return run


def _verified(threshold: float):
    """(node, linked, reaches): of each block's nodes the vectors linked to them here, and the least node they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            node, copies, key = (table.column(c).to_numpy() for c in ("node", "copies", "key"))
            units: np.ndarray | None = None
            lengths = np.zeros(len(node), np.int64)
            column = table.column("v").combine_chunks()
            for rows, matrix in _by_length(column):
                if units is None or units.shape[1] < matrix.shape[1]:
                    units = np.pad(units, ((0, 0), (0, matrix.shape[1] - units.shape[1]))) if units is not None else np.zeros((len(node), matrix.shape[1]))
                units[rows, : matrix.shape[1]] = unit(matrix)
                lengths[rows] = matrix.shape[1]
            keys, values = (_padded(table.column(c).combine_chunks(), fill) for c, fill in (("keys", _NO_KEY), ("values", np.nan)))
            reach = np.array([window(int(x), threshold) for x in lengths]) + 1e-6
            linked, low, high = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _colliding(table, threshold):
                use = (lengths[a] == lengths[b]) & (np.einsum("ij,ij->i", units[a], units[b]) >= threshold)
                a, b = a[use], b[use]
                for s in range(0, len(a), 4096):  # a pair counts in the first projection with a window that holds both
                    x, y = a[s : s + 4096], b[s : s + 4096]
                    met = (keys[x][:, :, None] == keys[y][:, None, :]) & (np.abs(values[x][:, :, None] - values[y][:, None, :]) <= reach[x][:, None, None])
                    own = np.where(met.any(axis=2), keys[x], _NO_KEY).min(axis=1) == key[x]
                    np.add.at(linked, x[own], copies[y[own]])
                    np.add.at(linked, y[own], copies[x[own]])
                low.append(a)
                high.append(b)
            order = np.argsort(node, kind="stable")  # the least row of a component has its least node
            place = np.empty(len(node), np.int64)
            place[order] = np.arange(len(node))
            a, b = np.concatenate(low), np.concatenate(high)
            root = order[_roots(len(node), place[a], place[b])[place]]
            live = np.flatnonzero((linked > 0) | (root != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays([pa.array(node[live]), pa.array(linked[live]), pa.array(node[root[live]])], ["node", "linked", "reaches"])

    return run


_BLOCK = "key long, i int, j int, chunk int, node long, value float, code binary, d int"


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links, components and what is kept of vectors (vec_id, embedding, label); see the module for the columns."""
    v = F.col("v")
    sound = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["label"].alias("label"), F.transform(table["embedding"], lambda c: c.cast("double")).alias("v"))
    rows = rows.select("vec_id", "label", "v", sound.alias("sound"))
    name = F.xxhash64("label", "v")
    ids = rows.select("vec_id", F.when(F.col("sound"), name).alias("node"))
    nodes = rows.filter("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select(name.alias("node"), F.xxhash64("label").alias("salt"), "least", "copies", "v"), "vectors")

    placed = written(nodes.select("node", "salt", "v").mapInArrow(_places(nodes.count(), threshold), "node long, keys array<long>, values array<float>, code binary, d int"), "places")
    members = placed.select("node", "code", "d", F.explode(F.arrays_zip("keys", "values")).alias("x")).select("node", "code", "d", F.col("x.keys").alias("key"), F.col("x.values").alias("value"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK_NODES).cast("int").alias("parts"))
    members = members.join(sizes, "key")
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    spread = members.select("key", "node", "value", "code", "d", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = spread.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "value", "code", "d")
    passed = written(_in_order(blocks).mapInArrow(_passed(threshold), _BLOCK), "passed")

    about = placed.select("node", "keys", "values").join(nodes.select("node", "copies", "v"), "node")
    links = written(_in_order(passed.join(about, "node")).mapInArrow(_verified(threshold), "node long, linked long, reaches long"), "vector-links")

    drop(passed.written_to)
    drop(placed.written_to)

    roots = connected_components(links.select(F.col("node").alias("a"), F.col("reaches").alias("b")))
    totals = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    least = written(roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "vector-ids")
    component = join_spread(roots, least, "root", "n").select("node", "component_id")
    known = nodes.select("node", "least", "copies").join(totals, "node", "left").join(component, "node", "left")
    known = written(known.select("node", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-classes")
    for done in (nodes, links, least):
        drop(done.written_to)
    joined = join_spread(ids.filter("node is not null"), known, "node", "copies").select("vec_id", "n_links", "component_id")
    alone = ids.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _in_order(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "value")
