"""Exhaustive distances between two tables, block against block.

Rows of either table are gathered into blocks of bounded size; every target block meets every
supplemental block.  Supplemental blocks are dealt to tiles of bounded bytes and target blocks to groups;
a task has one tile and reads the target blocks of one group one by one.  So a target block is
shuffled once for each tile and a supplemental block once for each group, and both numbers are chosen
to move the fewest bytes for the tasks wanted.  No pair is skipped and no pair becomes a row: a task
keeps a matrix for a slice of its blocks and gives sums, minima and counts, those of supplemental rows once
for all its targets.  The memory of a task is bounded, and both tables can be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a pair is charged for a feature that either row lacks: the expected squared difference of standard scores.
MISSING_PENALTY = 2.0
TARGET_ROWS = 2048
SUPPLEMENTAL_ROWS = 16384
#: Cells of a block, and of a distance matrix that a task holds at a time.
BLOCK_CELLS = 1 << 18
MOST_CELLS = 1 << 17
#: Bytes of the supplemental blocks that a task holds.
TILE_BYTES = 32 << 20
#: Tasks for each core, if the tables have rows enough.
TASKS_PER_CORE = 2
LEAST_ROWS = 64
#: Tasks of one pass; further pairs of groups and tiles share them.
MOST_TASKS = 20_000


def sum_terms(terms: Sequence):
    """The sum in the fixed order that ties depend on: in sequence below eight terms, else in eight strands."""
    n = len(terms)
    if n < 8 or n > 128:
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total
    strands = list(terms[:8])
    whole = n - n % 8
    for k in range(8, whole):
        strands[k % 8] = strands[k % 8] + terms[k]
    total = ((strands[0] + strands[1]) + (strands[2] + strands[3])) + ((strands[4] + strands[5]) + (strands[6] + strands[7]))
    for t in terms[whole:]:
        total = total + t
    return total


def running_sum(term: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """``sum_terms`` of n new arrays, bit for bit, with no more than nine of them at a time."""
    if n < 8 or n > 128:
        total = term(0)
        for k in range(1, n):
            total += term(k)
        return total
    strands = [term(k) for k in range(8)]
    whole = n - n % 8
    for k in range(8, whole):
        strands[k % 8] += term(k)
    while len(strands) > 1:
        strands = [np.add(x, y, out=x) for x, y in zip(strands[::2], strands[1::2], strict=True)]
    for k in range(whole, n):
        strands[0] += term(k)
    return strands[0]


def squared(a: np.ndarray, b: np.ndarray) -> Callable[[int], np.ndarray]:
    """The matrix of squared differences of feature k, with the penalty where a cell is missing."""
    missing_a, missing_b = np.isnan(a), np.isnan(b)
    any_a, any_b = missing_a.any(axis=0), missing_b.any(axis=0)

    def term(k: int) -> np.ndarray:
        t = np.subtract.outer(a[:, k], b[:, k])
        np.multiply(t, t, out=t)
        if any_a[k]:
            t[missing_a[:, k], :] = MISSING_PENALTY
        if any_b[k]:
            t[:, missing_b[:, k]] = MISSING_PENALTY
        return t

    return term


def unshared(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Marks of pairs that share no observed feature; None where all share one."""
    seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
    if seen_a.sum(axis=1).min(initial=a.shape[1]) + seen_b.sum(axis=1).min(initial=a.shape[1]) > a.shape[1]:
        return None
    return seen_a.astype(np.float32) @ seen_b.astype(np.float32).T == 0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): Euclidean distances; nan cells are missing, inf where no feature is shared."""
    d = running_sum(squared(a, b), a.shape[1])
    np.sqrt(d, out=d)
    if (lost := unshared(a, b)) is not None:
        d[lost] = np.inf
    return d


@dataclass
class Blocks:
    """(block, idx, cells, extra...): the rows of a table in blocks numbered from 0, and how many blocks and rows there are."""

    rows: DataFrame
    n: int
    n_rows: int


def block_rows(n_target: int, n_supplemental: int, width: int, cores: int) -> tuple[int, int]:
    """Rows of a target and of a supplemental block: bounded in cells, and small enough that all cores have work."""
    t, s = (min(most, max(LEAST_ROWS, BLOCK_CELLS // width)) for most in (TARGET_ROWS, SUPPLEMENTAL_ROWS))
    wanted = TASKS_PER_CORE * cores
    while t > LEAST_ROWS and -(-n_target // t) * -(-n_supplemental // s) < wanted:
        t //= 2
    while s > LEAST_ROWS and -(-n_target // t) * -(-n_supplemental // s) < wanted:
        s //= 2
    return t, s


def block_of(index: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(index), F.lit(n)).cast("int")


def blocked(table: DataFrame, index: str, cells: str, n_rows: int, rows: int, scales: Sequence[tuple[float, float]] | None = None, turn: Callable[[np.ndarray], np.ndarray] | None = None) -> Blocks:
    """A table of ``n_rows`` in blocks of ``rows`` on average: rows are dealt by a hash of their index.

    ``cells`` is an array column of doubles, all of one length; with ``scales``, a mean and a deviation a
    feature, cells become standard scores, and ``turn`` makes others of these.
    """
    n = max(1, -(-n_rows // rows))
    dealt = table.select(block_of(F.col(index), n).alias("block"), F.col(index).cast("long").alias("idx"), F.col(cells).alias("cells"))
    means, deviations = (np.array([s[k] for s in scales or ()]) for k in range(2))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).sort_by("idx").combine_chunks()
            held.clear()
            cells = whole.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(whole.num_rows, -1)
            if scales is not None:
                cells = (cells - means) / deviations
            if turn is not None:
                cells = turn(cells)
            data = [whole.column(1).to_numpy().tobytes(), cells.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["block", "idx", "cells"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                if held and block[a] != current:
                    yield out()
                current = int(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return Blocks(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(gather, "block int, idx binary, cells binary"), n, n_rows)


def with_figures(targets: Blocks, figures: DataFrame, width: int, columns: Sequence[str]) -> Blocks:
    """The rows of blocks that a table (target_idx, columns...) names, with its columns of doubles; blocks without any go."""
    asked = figures.select(block_of(F.col("target_idx"), targets.n).alias("block"), F.struct("target_idx", *(F.col(c).cast("double").alias(c) for c in columns)).alias("x"))
    asked = asked.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("x"))  # no more than the rows of a block
    joined = targets.rows.join(asked, "block").select("block", "idx", "cells", *(F.col(f"x.{c}").alias(c) for c in ("target_idx", *columns)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                idx, cells = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64), np.frombuffer(batch.column(2)[k].as_buffer()).reshape(-1, width)
                named, *values = (batch.column(3 + c)[k].values.to_numpy(zero_copy_only=False) for c in range(1 + len(columns)))
                at = np.searchsorted(idx, named)  # either ascends
                data = [idx[at].tobytes(), cells[at].tobytes(), *(v.astype(float).tobytes() for v in values)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([x], pa.binary()) for x in data)], ["block", "idx", "cells", *columns])

    return Blocks(joined.mapInArrow(chosen, "block int, idx binary, cells binary" + "".join(f", {c} binary" for c in columns)), targets.n, targets.n_rows)


def tiles_and_groups(targets: Blocks, supplementals: Blocks, width: int, cores: int) -> tuple[int, int]:
    """Tiles of supplemental blocks and groups of target blocks: tiles within their bytes, tasks for all cores, and the fewest bytes moved."""
    tasks = TASKS_PER_CORE * cores
    least = -(-supplementals.n_rows * width * 8 // TILE_BYTES)
    best = math.sqrt(tasks * supplementals.n_rows / max(1, targets.n_rows))
    tiles = min(supplementals.n, max(least, round(best), -(-tasks // targets.n), 1))
    return tiles, min(targets.n, max(1, -(-tasks // tiles)))


def met(targets: Blocks, supplementals: Blocks, width: int, extra: Sequence[str] = ()) -> DataFrame:
    """Rows (task, target, idx, cells, ...): in each task the blocks of a tile stand before the target blocks that they meet."""
    cores = targets.rows.sparkSession.sparkContext.defaultParallelism
    tiles, groups = tiles_and_groups(targets, supplementals, width, cores)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = targets.rows.select(numbers(tiles).alias("s"), F.pmod("block", F.lit(groups)).alias("g"), F.lit(True).alias("target"), "idx", "cells", *extra)
    right = supplementals.rows.select(F.pmod("block", F.lit(tiles)).alias("s"), numbers(groups).alias("g"), F.lit(False).alias("target"), "idx", "cells", *(F.lit(None).cast("binary").alias(c) for c in extra))
    both = left.unionByName(right).select((F.col("g").cast("long") * tiles + F.col("s")).alias("task"), "target", "idx", "cells", *extra)
    most = min(groups * tiles, max(MOST_TASKS, cores))
    return both.repartitionById(most, F.pmod("task", F.lit(most)).cast("int")).sortWithinPartitions("task", "target")


def over_blocks(pairs: DataFrame, width: int, schema: str, kernel: Callable, extra: Sequence[str] = ()) -> DataFrame:
    """``kernel(tile)`` for each task, where a tile is a list of (s_idx, b).

    Its ``target(t_idx, a, *extras)`` is called for each target block and ``end()`` after the last; both give
    a dict of arrays for columns of one row, those left out are empty, or None for no row.  A kernel with a ``BATCH``
    gets its target blocks together, up to that many rows, and may give record batches of the schema instead.
    """
    kinds = dict(x.strip().split(" ", 1) for x in schema.split(", "))
    types = {n: pa.int64() if "long" in k else pa.float64() for n, k in kinds.items()}

    def row(found: dict) -> pa.RecordBatch:
        arrays = []
        for n, kind in types.items():
            x = found.get(n, np.zeros(0, kind.to_pandas_dtype()))
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)))
        return pa.RecordBatch.from_arrays(arrays, list(kinds))

    def results(work, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = work.target(*(np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held, strict=True)))
        held.clear()
        if isinstance(found, dict):
            yield row(found)
        elif found is not None:
            yield from found

    def ended(work, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from results(work, held)
        if work is not None and (found := work.end()) is not None:
            yield row(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[list[np.ndarray]] = []
        now, work = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                task, target = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                idx, cells = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64), np.frombuffer(batch.column(3)[k].as_buffer()).reshape(-1, width)
                if task != now:
                    yield from ended(work, held)
                    tile, now, work = [], task, None
                if not target:
                    tile.append((idx.copy(), cells.copy()))
                    continue
                if not tile or not len(idx):  # a tile without rows
                    continue
                if work is None:
                    work = kernel(tile)
                held.append([idx, cells, *(np.frombuffer(batch.column(c)[k].as_buffer()) for c in extra)])
                if sum(len(x[0]) for x in held) >= getattr(work, "BATCH", 1):
                    yield from results(work, held)
        yield from ended(work, held)

    return pairs.mapInArrow(run, schema)


def slices(n: int, width: int, most: int | None = None) -> Iterator[slice]:
    step = max(1, (most or MOST_CELLS) // max(width, 1))
    for k in range(0, n, step):
        yield slice(k, min(k + step, n))
