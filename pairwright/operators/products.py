"""Distances of two blocks by one matrix product, with bounds that decide where the exact sums are needed.

For all pairs of a slice one product gives a number that is at most the squared distance, and less than it by
a proven error at most.  Minima, ties, next distances and ratios are decided by it wherever the bound is
clear; the few pairs within the error are summed term by term in the fixed order of ``blocks``,
so every result is the same, bit for bit, as that of the plain matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import blocks

#: Half the spacing of doubles at 1: the error of one rounding.
UNIT = 2.0**-53
#: Features from which the product takes less time than the sums.
LEAST_WIDTH = 5
#: Pairs summed at a time, and slices as a multiple of those of the plain matrices.
_EXACT_PAIRS = 1 << 15
_WIDER = 4


class Side:
    """A block with its squares and their errors; nan cells are missing."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.d = x, x.shape[1]
        self.seen = ~np.isnan(x)
        self.whole = bool(self.seen.all())
        self.z = np.where(self.seen, x, 0.0)
        with np.errstate(over="ignore"):
            self.squares = self.z * self.z
            self.norm = self.squares.sum(axis=1)
            # Each sum, in whatever order, differs from the true one by at most as many roundings of the sum of its terms' sizes as
            # it has terms, and two.  The terms' sizes come to at most 2 (|a|**2 + |b|**2) + 4 d, half of which is told here.
            # The product of at most 3 d + 2 terms and the plain sum of d terms both have such an error.
            self.err = 1.01 * UNIT * (4 * self.d + 16) * (2 * self.norm + 4 * self.d)
        self.least_seen = int(self.seen.sum(axis=1).min(initial=self.d))
        self._matrices: dict[tuple[bool, bool], np.ndarray] = {}

    @property
    def sound(self) -> bool:
        """False where squares overflow, so that bounds say nothing."""
        return bool(np.isfinite(self.err).all())

    def matrix(self, left: bool, whole: bool) -> np.ndarray:
        """A factor of the product: |a|**2 + |b|**2 - 2 a . b for whole blocks, else with marks of observed cells

        az**2 . ob + oa . bz**2 - 2 az . bz + 2 (d - oa . ob).
        """
        if (left, whole) not in self._matrices:
            own, one = (self.norm - self.err)[:, None], np.ones((len(self.z), 1))
            seen, penalty = self.seen.astype(float), blocks.MISSING_PENALTY
            if whole:
                parts = [-2 * self.z, own, one] if left else [self.z, one, own]
            elif left:
                parts = [-2 * self.z, self.squares, seen, -self.err[:, None], one]
            else:
                parts = [self.z, seen, self.squares - penalty * seen, one, (penalty * self.d - self.err)[:, None]]
            self._matrices[left, whole] = np.hstack(parts)
        return self._matrices[left, whole]


class Pair:
    """A target block and a supplemental block."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b = a, b
        whole = a.whole and b.whole
        self.left, self.right = a.matrix(True, whole), b.matrix(False, whole).T
        # Pairs that share no feature are infinitely far; where every two rows share one, none needs a look.
        self.lost = None if a.least_seen + b.least_seen > a.d else (a.seen.astype(np.float32), b.seen.astype(np.float32).T)

    def slices(self) -> Iterator[slice]:
        return blocks.slices(len(self.a.x), len(self.b.x), _WIDER * blocks.MOST_CELLS)

    def lower(self, rows: slice) -> np.ndarray:
        """At most the squared distances of a slice of the targets to all of the others, in a new matrix; less by twice both errors at most."""
        out = self.left[rows] @ self.right
        if self.lost is not None:
            out[self.lost[0][rows] @ self.lost[1] == 0] = np.inf
        return out

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the pairs (target row, other row), summed as in ``blocks.distances``."""
        out = np.empty(len(i))
        for k in range(0, len(i), _EXACT_PAIRS):
            x, y = self.a.x[i[k : k + _EXACT_PAIRS]], self.b.x[j[k : k + _EXACT_PAIRS]]
            gaps = x - y
            gaps *= gaps
            if not (self.a.whole and self.b.whole):
                lost = np.isnan(gaps)
                gaps[lost] = blocks.MISSING_PENALTY
            gaps = np.ascontiguousarray(gaps.T)
            d = np.sqrt(blocks.running_sum(lambda c, gaps=gaps: gaps[c].copy(), len(gaps)))
            if self.lost is not None:
                d[lost.all(axis=1)] = np.inf
            out[k : k + _EXACT_PAIRS] = d
        return out

    def least(self, low: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least exact distance of each row of a slice, and the pairs (row of the slice, column) that attain it."""
        n = len(low)
        row = np.arange(n)
        best = low.argmin(axis=1)
        bound = self.exact(row + start, best)
        limit = np.where(np.isinf(low[row, best]), -np.inf, ceiling(bound))
        i, j = np.nonzero(low <= limit[:, None])
        d = self.exact(i + start, j)
        found = np.full(n, np.inf)
        np.minimum.at(found, i, d)
        at = d == found[i]
        return found, i[at], j[at]

    def least_of_columns(self, low: np.ndarray, rows: slice, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least exact distance of each column of a slice that is not above ``before``, and how often it is there."""
        top = low.min(axis=0)
        with np.errstate(invalid="ignore"):
            bound = (top + 2 * (self.a.err[rows].max() + self.b.err)) * (1 + 8 * UNIT)
            limit = np.where(np.isinf(top), -np.inf, np.minimum(bound, ceiling(before)))
        i, j = np.nonzero(low <= limit)
        d = self.exact(i + rows.start, j)
        found = np.full(low.shape[1], np.inf)
        np.minimum.at(found, j, d)
        count = np.bincount(j[d == found[j]], minlength=low.shape[1])
        return found, np.where(np.isinf(top), len(low), count)  # all rows of a column without a finite distance

    def greatest(self, low: np.ndarray, rows: slice) -> np.ndarray:
        """Greatest finite exact distance of each row of a slice; -inf where none is."""
        finite = np.where(np.isinf(low), -np.inf, low)
        edge = finite.max(axis=1) - 2 * (self.a.err[rows] + self.b.err.max()) * (1 + 8 * UNIT) - np.abs(finite.max(axis=1)) * 8 * UNIT
        i, j = np.nonzero(finite >= np.where(np.isnan(edge) | np.isinf(edge), np.inf, edge)[:, None])
        out = np.full(len(low), -np.inf)
        np.maximum.at(out, i, self.exact(i + rows.start, j))
        return out


def ceiling(d: np.ndarray) -> np.ndarray:
    """A square that no plain sum whose root is at most d exceeds."""
    with np.errstate(over="ignore"):
        return d * d * (1 + 8 * UNIT)


def within(pair: Pair, d1: np.ndarray, threshold: float) -> np.ndarray:
    """Of each target row the other rows at a distance d above 0 with d1 / d of the threshold or more."""
    near = np.zeros(len(d1), np.int64)
    with np.errstate(over="ignore"):
        edge = (d1 / threshold) ** 2
    far, sure = edge * (1 + 16 * UNIT), edge * (1 - 16 * UNIT)
    for rows in pair.slices():
        low = pair.lower(rows)
        i, j = np.nonzero(low <= far[rows, None])
        value = low[i, j]
        clear = (value + 2 * (pair.a.err[i + rows.start] + pair.b.err[j]) < sure[i + rows.start]) & (value > 0)
        near[rows] = np.bincount(i[clear], minlength=len(low))
        i, j = i[~clear], j[~clear]
        d = pair.exact(i + rows.start, j)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = (d > 0) & (d1[i + rows.start] / d >= threshold)
        near[rows] += np.bincount(i[hit], minlength=len(low))
    return near


def closest(pair: Pair, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(target rows, other rows, distances) of all pairs up to the k-th distance of each row, slice by slice."""
    m = min(k, len(pair.b.x))
    for rows in pair.slices():
        low = pair.lower(rows)
        some = np.argpartition(low, m - 1, axis=1)[:, :m]
        row = np.repeat(np.arange(len(low)), m)
        bound = pair.exact(row + rows.start, some.ravel()).reshape(-1, m).max(axis=1)
        i, j = np.nonzero((low <= ceiling(bound)[:, None]) & (low < np.inf))
        yield i + rows.start, j, pair.exact(i + rows.start, j)
