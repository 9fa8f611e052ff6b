"""Exact histograms of each target's distances, without a look at every pair where rows lie on long lines.

Distinct supplemental rows that agree in all features but one are a line, sorted by that one, its axis.  Along a line the
distance from a target falls up to the target's own cell and grows behind it, and so does its bin: each operation, correctly
rounded, is monotone, and so is the bin of a distance.  So the rows below a bin's edge are a run of the line, whose two ends are
searched: a place from arithmetic, then the very distances on both sides of it, and halving where they do not confirm it.  Rows of
short lines are compared one by one.  Counts are the same as those of plain matrices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from . import blocks, leaves

ROW_SCHEMA = "target_idx long, near long, lo double, hi double, n array<long>"
#: Distinct rows of a line for each bin from which on searches cost less than comparisons (measured).
ROWS_PER_BIN = 3
#: Views of a tile that a task keeps.
_VIEWS = 4
#: Counts of a batch of targets.
_COUNTS = 1 << 22


def rows_of(t_idx: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row a target; nulls instead of a range and counts where it has none."""
    has = ~np.isnan(low)
    offsets = pa.array(np.concatenate([[0], np.cumsum(has)]) * counts.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(counts[has].ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(t_idx, pa.int64()), pa.array(near, pa.int64()), *(pa.array(x, pa.float64(), mask=~has) for x in (low, high)), lists], ["target_idx", "near", "lo", "hi", "n"])


def bin_of(d: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """The bin of a distance between ``low`` and ``high``; never falls where the distance grows."""
    step = (high - low) / bins
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        k = np.where(np.isfinite(d), (d - low) / (high - low) * bins, 0)
        k = np.where(np.isnan(k), 0, k).astype(np.int64)
    k[k == bins] = bins - 1
    upper = np.where(k + 1 == bins, high, low + (k + 1) * step)
    return np.where(d < low + k * step, k - 1, np.where((d >= upper) & (k != bins - 1), k + 1, k))


def counted(d: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(rows of d, bins): how many finite distances of each row lie in each bin, column j counted ``weight[j]`` times; none where low is nan."""
    k = bin_of(d, low[:, None], high[:, None], bins)
    k += np.arange(len(d))[:, None] * bins
    use = np.isfinite(d) & ~np.isnan(low)[:, None]
    if use.all():
        weights = None if weight is None else np.broadcast_to(weight, d.shape).ravel()
        k = k.ravel()
    else:
        weights = None if weight is None else np.broadcast_to(weight, d.shape)[use]
        k = k[use]
    return np.bincount(k, weights, minlength=len(d) * bins).astype(np.int64).reshape(-1, bins)


def thresholds(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """(targets, bins): the least distance from ``low`` to ``high`` in bin k or a later one, for k from 1, inf for none; the last is inf."""
    k = np.arange(1, bins)
    lo, hi = np.maximum(low, 0.0)[:, None], high[:, None]
    least = np.clip(low[:, None] + k * ((hi - low[:, None]) / bins), lo, hi)

    def reached(d: np.ndarray) -> np.ndarray:
        return bin_of(d, low[:, None], hi, bins) >= k

    below = np.nextafter(least, -np.inf)
    i, j = np.nonzero(~reached(least) | ((below >= lo) & reached(below)))
    if len(i):  # rounding: halve the range of their bits, which ascend as distances do
        at = lambda bits: bin_of(bits.view(np.float64), low[i], high[i], bins) >= k[j]
        begin, end = lo[i, 0].view(np.int64), high[i].view(np.int64) + 1
        while (open_ := begin < end).any():
            middle = begin + (end - begin) // 2
            hit = at(np.minimum(middle, high[i].view(np.int64)))
            begin, end = np.where(open_ & ~hit, middle + 1, begin), np.where(open_ & hit, middle, end)
        least[i, j] = np.where(begin > high[i].view(np.int64), np.inf, begin.view(np.float64))
    return np.column_stack([least, np.full(len(low), np.inf)])


class Line:
    """Distinct rows that are equal in all observed features but ``axis``: their cells there, ascending, and how many rows they are."""

    def __init__(self, x: np.ndarray, axis: int, n: np.ndarray) -> None:
        self.axis, self.fixed = axis, x[0]
        self.cells = np.concatenate([[-np.inf], x[:, axis], [np.inf]])  # row i stands at i + 1
        self.total = np.concatenate([[0], np.cumsum(n)])

    def below(self, a: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """(targets, limits): how many rows are at a distance less than each limit."""
        m = len(self.total) - 1
        terms = [np.where(np.isnan(t), blocks.MISSING_PENALTY, t)[:, None] for t in np.square(a - self.fixed).T]
        own = a[:, self.axis, None]
        others = sum((t for c, t in enumerate(terms) if c != self.axis), np.zeros((len(a), 1)))
        reach = np.sqrt(np.maximum(limit * limit - others, 0.0))
        middle = np.searchsorted(self.cells[1:-1], own)
        # Row `right` is the first one behind the target's cell that is not below the limit, row `left` the first one that is.
        right = np.maximum(np.searchsorted(self.cells[1:-1], own + reach), middle)
        left = np.minimum(np.searchsorted(self.cells[1:-1], own - reach, "right"), middle)

        def distance(row: np.ndarray, some: Sequence[np.ndarray] | None = None) -> np.ndarray:
            """From targets to their rows, from the same operations in the same order as ``blocks.distances``."""
            at = (lambda x: x) if some is None else (lambda x: np.broadcast_to(x, limit.shape)[some])

            def term(c: int) -> np.ndarray:
                if c != self.axis:
                    return np.broadcast_to(at(terms[c]), row.shape).copy()
                t = at(own) - self.cells[row + 1]
                return np.multiply(t, t, out=t)

            return np.sqrt(blocks.running_sum(term, len(terms)))

        wrong = (distance(right) < limit) | ((distance(right - 1) >= limit) & (right > middle))
        if wrong.any():
            some = np.nonzero(wrong)
            right[some] = _first(np.broadcast_to(middle, limit.shape)[some], np.full(len(some[0]), m), lambda row: distance(row, some) >= limit[some])
        wrong = (distance(left - 1) < limit) | ((distance(left) >= limit) & (left < middle))
        if wrong.any():
            some = np.nonzero(wrong)
            left[some] = _first(np.zeros(len(some[0]), np.int64), np.broadcast_to(middle, limit.shape)[some], lambda row: distance(row, some) < limit[some])
        return self.total[right] - self.total[left]


def _first(begin: np.ndarray, end: np.ndarray, hit) -> np.ndarray:
    """The first number of each range that is hit, as all behind it are; the end where none is."""
    while (open_ := begin < end).any():
        middle = begin + (end - begin) // 2
        yes = hit(middle)
        begin, end = np.where(open_ & ~yes, middle + 1, begin), np.where(open_ & yes, middle, end)
    return begin


class _View:
    """The distinct rows of a tile, as targets see them that miss some cells: long lines, and the other rows with their counts."""

    def __init__(self, x: np.ndarray, n: np.ndarray, missing: np.ndarray, least: int) -> None:
        x, place = leaves.distinct(np.where(missing, np.nan, x))
        n = np.bincount(place, n, minlength=len(x)).astype(np.int64)
        self.lines: list[Line] = []
        rest = []
        pattern = np.isnan(x) @ (1 << np.arange(x.shape[1]))
        for p in np.unique(pattern):
            rows = np.flatnonzero(pattern == p)
            seen = np.flatnonzero(~np.isnan(x[rows[0]]))
            if not len(seen):  # infinitely far
                continue
            order, start, axis = min((self._along(x[rows], seen, c) for c in seen), key=lambda found: len(found[1]))
            for run in np.split(rows[order], start[1:]):
                if len(run) < least:
                    rest.append(run)
                else:
                    self.lines.append(Line(x[run], axis, n[run]))
        rest = np.concatenate([np.zeros(0, np.int64), *rest])
        self.x, self.n = x[rest], n[rest]

    @staticmethod
    def _along(x: np.ndarray, seen: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows in the order of their lines along an axis, and where each line starts."""
        others = [c for c in seen if c != axis]
        order = np.lexsort([x[:, axis], *(x[:, c] for c in others)])
        own = x[order][:, others]
        return order, np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])), axis


class Binned(leaves.Counted):
    """As ``match._Counted`` with bins: near misses beside d1, and counts of ``bins`` equal bins from low to high."""

    SCHEMA = ROW_SCHEMA

    def __init__(self, tile: list, threshold: float, bins: int) -> None:
        super().__init__(tile, threshold)
        self.bins, self.views = bins, {}
        self.BATCH = max(1, _COUNTS // bins)

    def target(self, t_idx: np.ndarray, x: np.ndarray, d1: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = super().target(t_idx, x, d1)["near"] if not np.isnan(d1).all() else np.zeros(len(t_idx), np.int64)
        rows, place = leaves.distinct(np.column_stack([x, low, high]))
        counts = np.zeros((len(rows), self.bins), np.int64)
        has = ~np.isnan(rows[:, -1])
        pattern = np.isnan(rows[:, :-2]) @ (1 << np.arange(x.shape[1]))
        for p in np.unique(pattern[has]):
            own = np.flatnonzero(has & (pattern == p))
            self._count(own, rows[own, :-2], rows[own, -2], rows[own, -1], counts)
        for part in blocks.slices(len(t_idx), self.bins):
            yield rows_of(t_idx[part], near[part], low[part], high[part], counts[place[part]])

    def _count(self, own: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> None:
        """Targets that miss the same cells are counted."""
        view = self._seen_by(np.isnan(a[0]))
        if view.lines:
            for part in blocks.slices(len(a), self.bins):
                limit, below = thresholds(low[part], high[part], self.bins), 0
                for line in view.lines:
                    below = below + line.below(a[part], limit)
                counts[own[part]] += np.diff(below, axis=1, prepend=0)
        if len(view.x):
            for part in blocks.slices(len(a), len(view.x)):
                counts[own[part]] += counted(blocks.distances(a[part], view.x), low[part], high[part], self.bins, view.n if (view.n > 1).any() else None)

    def _seen_by(self, missing: np.ndarray) -> _View:
        key = missing.tobytes()
        if key not in self.views:
            while len(self.views) >= _VIEWS:
                del self.views[next(iter(self.views))]
            b = self.tile.whole
            self.views[key] = _View(b.x, b.n, missing, ROWS_PER_BIN * self.bins)
        return self.views[key]
