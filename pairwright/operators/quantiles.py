"""Exact quantiles of whole columns by distributed selection.

The bits of a double, with those below the sign turned over for negative numbers, are in the order of the
numbers.  A pass counts the values by their first 16 bits; only the buckets that hold a wanted rank are
counted by their next 16 bits, and so on, until few enough values are left to be looked at.  A task
holds counters, never the values of a column, and the driver sees a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a step; values that come to the driver for one bucket.
STEP = 16
FEW = 4096


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _number(key: int) -> float:
    bits = np.array([key], np.uint64) ^ np.uint64(1 << 63)
    bits = bits.view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def _values(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column(column).drop_null().to_numpy(zero_copy_only=False).astype(float)
        yield x[~np.isnan(x)]


def _counts(values: DataFrame, wanted: dict[int, set[int]], known: int) -> dict[tuple[int, int], int]:
    """How many values of each column begin with the ``known`` bits wanted and which ``STEP`` bits follow, by (column, key so far)."""
    places = {c: np.array(sorted(p), np.uint64) for c, p in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros((len(p), 1 << STEP), np.int64) for c, p in places.items()}
        for batch in batches:
            for c, prefixes in places.items():
                for x in _values(iter([batch]), c):
                    key = _ordered(x)
                    head = key >> np.uint64(64 - known) if known else np.zeros(len(key), np.uint64)
                    at = np.searchsorted(prefixes, head).clip(max=len(prefixes) - 1)
                    use = prefixes[at] == head
                    step = (key[use] >> np.uint64(64 - known - STEP)) & np.uint64((1 << STEP) - 1)
                    np.add.at(total[c], (at[use], step.astype(np.int64)), 1)
        for c, counts in total.items():
            at, step = np.nonzero(counts)
            key = (places[c][at] << np.uint64(STEP)) | step.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(key.view(np.int64)), pa.array(counts[at, step])], ["c", "key", "n"])

    rows = values.mapInArrow(run, "c int, key long, n long").groupBy("c", "key").agg(F.sum("n").alias("n")).collect()  # 2**STEP a bucket at most
    return {(r["c"], r["key"] & ((1 << 64) - 1)): r["n"] for r in rows}


def _some(values: DataFrame, column: int, prefix: int, known: int) -> list[int]:
    """All keys of a column that begin with the known bits; the caller has counted them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _values(batches, column):
            key = _ordered(x)
            yield pa.RecordBatch.from_arrays([pa.array(key[key >> np.uint64(64 - known) == np.uint64(prefix)].view(np.int64))], ["key"])

    return sorted(r["key"] & ((1 << 64) - 1) for r in values.mapInArrow(run, "key long").collect())


def exact_quantiles(table: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """For each name the quantile of a column, between the two nearest values in proportion; null and NaN do not count, none gives None.

    The table is read three or four times, so it should be a written one.
    """
    if not wanted:
        return {}
    columns = list({str(c): c for c, _ in wanted.values()}.values())
    place = {str(c): k for k, c in enumerate(columns)}
    values = table.select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    found: dict[tuple[int, int], int] = {}  # (column, rank): key
    sizes: dict[int, int] = {}
    #: (column, prefix) to the number of values before it, and the ranks looked for in it.
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {(k, 0): (0, []) for k in range(len(columns))}
    for known in range(0, 64, STEP):
        prefixes: dict[int, set[int]] = {}
        for c, p in open_:
            prefixes.setdefault(c, set()).add(p)
        counts = _counts(values, prefixes, known)
        if not known:
            for (c, _), n in counts.items():
                sizes[c] = sizes.get(c, 0) + n
            for c, q in {(place[str(c)], q) for c, q in wanted.values()}:
                if sizes.get(c):
                    at = q * (sizes[c] - 1)
                    open_[c, 0][1].extend([math.floor(at), math.ceil(at)])
        after: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (c, p), (before, ranks) in open_.items():
            own = sorted(key for (d, key) in counts if d == c and key >> STEP == p)
            for key in own:
                n = counts[c, key]
                here = [r for r in set(ranks) if before <= r < before + n]
                if here and known + STEP == 64:
                    found |= {(c, r): key for r in here}
                elif here and n <= FEW:
                    keys = _some(values, c, key, known + STEP)
                    found |= {(c, r): keys[r - before] for r in here}
                elif here:
                    after[c, key] = (before, here)
                before += n
        open_ = after
        if not open_:
            break

    def one(c: int, q: float) -> float | None:
        if not sizes.get(c):
            return None
        at = q * (sizes[c] - 1)
        low, high = (_number(found[c, f(at)]) for f in (math.floor, math.ceil))
        return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high

    return {name: one(place[str(c)], q) for name, (c, q) in wanted.items()}
