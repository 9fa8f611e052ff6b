"""Exact nearest rows of tables with few features, without a look at every pair.

A task makes of its tile, and of a batch of targets, distinct rows with counts, and puts those into leaves: small
groups that are close to each other and miss the same cells.  The ranges of two leaves give a least and a greatest
distance of their pairs, from the same operations in the same order as ``blocks.distances``.  As each of these,
correctly rounded, never falls where its argument grows, no pair's distance lies outside, to the last bit.  So leaves that cannot
hold what is asked for are passed over, leaves that lie within a range as a whole are counted, and the others are
compared row by row: results are the same, bit for bit, as those of the plain matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from . import blocks

#: Rows of a leaf of targets and of one of supplemental rows.
TARGET_LEAF = 128
SUPPLEMENTAL_LEAF = 256
#: Leaves looked at first, and how many times more each further time.
_FIRST_LEAVES, _MORE = 2, 4
#: Views of a tile that a task keeps.
_VIEWS = 4
#: Numbers of one list of results.
_LIST_CELLS = 1 << 20


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of x, nan equal to nan, and the place of each row among them."""
    x = x + 0.0  # no negative zeros
    bits = np.where(np.isnan(x), np.int64(-1), np.ascontiguousarray(x).view(np.int64))
    order = np.lexsort(bits.T[::-1])
    new = np.ones(len(x), bool)
    new[1:] = (bits[order[1:]] != bits[order[:-1]]).any(axis=1)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[order[new]], place


class Leaves:
    """Distinct rows in leaves: ``x`` in the order of the leaves, ``n`` equal rows each, ``start`` of each leaf; members ascend by index.

    Only the order of members depends on ``idx``; row u has ``members[first[u] : first[u] + n[u]]``.
    """

    def __init__(self, idx: np.ndarray, x: np.ndarray, size: int) -> None:
        rows, place = distinct(x)
        order, ends = _leaves(rows, size)
        self.x = rows[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.place = rank[place]
        self.n = np.bincount(self.place, minlength=len(rows))
        self.first = np.cumsum(self.n) - self.n
        self.at = np.lexsort((idx, self.place))
        self.members = idx[self.at]
        self.least = self.members[self.first]
        self.start = np.concatenate([[0], ends])
        self.weight = np.add.reduceat(self.n, self.start[:-1])
        # A leaf misses a cell in all of its rows or in none.
        self.low = np.minimum.reduceat(self.x, self.start[:-1])
        self.high = np.maximum.reduceat(self.x, self.start[:-1])

    def __len__(self) -> int:
        return len(self.start) - 1

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        """The rows of some leaves, one leaf after the other."""
        size = self.start[leaves + 1] - self.start[leaves]
        return np.repeat(self.start[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows, and where leaves of at most ``size`` end in it: halves by the widest feature, rows that miss the same cells together."""
    missing = np.isnan(x) @ (1 << np.arange(x.shape[1]))
    parts = [np.flatnonzero(missing == m) for m in np.unique(missing)[::-1]]
    out: list[np.ndarray] = []
    while parts:
        rows = parts.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = x[rows]
        with np.errstate(invalid="ignore"):
            spread = np.nan_to_num(own.max(axis=0) - own.min(axis=0), nan=-1.0, posinf=np.finfo(float).max)
        half = len(rows) // 2
        cut = np.argpartition(own[:, spread.argmax()], half)
        parts += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(out), np.cumsum([len(r) for r in out])


def _between(a: Leaves, i: int, b: Leaves, least: bool) -> np.ndarray:
    """Of leaf i of a to every leaf of b, the bound that no pair's distance is below (``least``) or no finite one is above."""
    width = min(a.x.shape[1], b.x.shape[1])
    low, high = a.low[i, :width], a.high[i, :width]

    def term(k: int) -> np.ndarray:
        if least:
            gap = np.maximum(np.maximum(b.low[:, k] - high[k], low[k] - b.high[:, k]), 0.0)
        else:
            gap = np.maximum(b.high[:, k] - low[k], high[k] - b.low[:, k])
        return np.where(np.isnan(gap), blocks.MISSING_PENALTY, gap * gap)

    with np.errstate(over="ignore"):
        d = np.sqrt(blocks.running_sum(term, width))
    d[(np.isnan(low) | np.isnan(b.low)).all(axis=1)] = np.inf if least else -np.inf
    return d


def _ascending(bound: np.ndarray, limit: Callable[[], float]) -> Iterator[np.ndarray]:
    """Leaves by their bound, a few at first, as long as it is finite and at most the limit, which falls as they are met."""
    order = np.argsort(bound, kind="stable")
    done, more = 0, _FIRST_LEAVES
    while done < len(order):
        wanted = order[done : done + more]
        wanted = wanted[(bound[wanted] <= limit()) & (bound[wanted] < np.inf)]
        if not len(wanted):
            return
        yield wanted
        done, more = done + more, more * _MORE


class _Tile:
    """The supplemental rows of a task in leaves: ``whole``, and as targets see them that miss some cells.

    What a target misses costs it the same with every row.  So in its view rows that differ in nothing else are equal,
    and leaves are close in the cells that it has: those of the whole are long in them, and ever more would have to be looked at.
    """

    def __init__(self, tile: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.whole = Leaves(np.concatenate([i for i, _ in tile]), np.concatenate([x for _, x in tile]), SUPPLEMENTAL_LEAF)
        self.views: dict[bytes, Leaves] = {}

    def seen_by(self, a: Leaves, i: int) -> Leaves:
        """The tile in the view of leaf i of targets."""
        b = self.whole
        missing = np.isnan(a.low[i, : b.x.shape[1]])
        if not missing.any() or missing.all():  # without any cell they are infinitely far from all rows
            return b
        key = missing.tobytes()
        if key not in self.views:
            while len(self.views) >= _VIEWS:
                del self.views[next(iter(self.views))]
            self.views[key] = Leaves(b.members, np.repeat(np.where(missing, np.nan, b.x), b.n, axis=0), SUPPLEMENTAL_LEAF)
        return self.views[key]


def _marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.nonzero`` of a matrix, which takes several times as long where few cells are marked."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Nearest:
    """As ``match._Nearest``; without ``reverse`` nothing is found of supplemental rows."""

    SCHEMA = "t_idx array<long>, first array<double>, second array<double>, best array<long>, ties array<long>, high array<double>, s_idx array<long>, reverse array<double>, reverse_ties array<long>"
    BATCH = 1 << 18

    def __init__(self, tile: list, reverse: bool = True, with_range: bool = False) -> None:
        self.tile = _Tile(tile)
        self.b = self.tile.whole
        self.with_reverse, self.with_range = reverse, with_range
        self.reverse, self.reverse_ties = np.full(len(self.b.x), np.inf), np.zeros(len(self.b.x), np.int64)

    def target(self, t_idx: np.ndarray, x: np.ndarray) -> dict:
        a = Leaves(t_idx, x, TARGET_LEAF)
        n = len(a.x)
        self.first, self.second, self.high = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf)
        self.best, self.ties = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        seen = np.zeros((len(a), len(self.b)), bool) if self.with_reverse else None
        for i in range(len(a)):
            rows = slice(a.start[i], a.start[i + 1])
            b = self.tile.seen_by(a, i)
            give = self.with_reverse and b is self.b  # the other pairs come in _reversed, if they matter
            bound = _between(a, i, b, True)
            for leaves in _ascending(bound, lambda rows=rows: self.second[rows].max()):
                columns = b.rows(leaves)
                for part in blocks.slices(rows.stop - rows.start, len(columns)):
                    part = slice(part.start + rows.start, part.stop + rows.start)
                    d = blocks.distances(a.x[part], b.x[columns])
                    if give:
                        self._give(d, a.n[part], columns)
                    self._take(d, part, b, columns)
                if give:
                    seen[i, leaves] = True
            if self.with_range:
                self._farthest(a, i, b)
        if self.with_reverse:
            self._reversed(a, seen)
        at = a.place
        return {"t_idx": t_idx, "first": self.first[at], "second": self.second[at], "best": self.best[at], "ties": self.ties[at], "high": self.high[at]}

    def _farthest(self, a: Leaves, i: int, b: Leaves) -> None:
        """The greatest finite distance of each row of a leaf."""
        rows = slice(a.start[i], a.start[i + 1])
        for leaves in _ascending(-_between(a, i, b, False), lambda: -self.high[rows].min()):
            columns = b.rows(leaves)
            for part in blocks.slices(rows.stop - rows.start, len(columns)):
                part = slice(part.start + rows.start, part.stop + rows.start)
                d = blocks.distances(a.x[part], b.x[columns])
                d[np.isinf(d)] = -np.inf
                self.high[part] = np.maximum(self.high[part], d.max(axis=1))

    def _reversed(self, a: Leaves, seen: np.ndarray) -> None:
        """The leaves of targets that may yet be the nearest ones of some supplemental rows."""
        b = self.b
        for j in range(len(b)):
            rows = np.arange(b.start[j], b.start[j + 1])
            bound = np.where(seen[:, j], np.inf, _between(b, j, a, True))
            for leaves in _ascending(bound, lambda rows=rows: self.reverse[rows].max()):
                others = a.rows(leaves)
                for part in blocks.slices(len(others), len(rows)):
                    self._give(blocks.distances(a.x[others[part]], b.x[rows]), a.n[others[part]], rows)

    def _take(self, d: np.ndarray, part: slice, b: Leaves, columns: np.ndarray) -> None:
        """Targets take in their distances to some rows of b, which are lost."""
        least = d.min(axis=1)
        i, j = _marked(d == least[:, None])
        begin = np.searchsorted(i, np.arange(len(d)))
        count, own = np.add.reduceat(b.n[columns[j]], begin), np.minimum.reduceat(b.least[columns[j]], begin)
        d[i, j] = np.inf
        further, first = d.min(axis=1), self.first[part]
        lower, tied = least < first, least == first
        self.second[part] = np.where(lower, np.minimum(further, first), np.minimum(self.second[part], np.where(tied, further, least)))
        self.best[part] = np.where(lower, own, np.where(tied, np.minimum(self.best[part], own), self.best[part]))
        self.ties[part] = np.where(lower, count, self.ties[part] + np.where(tied, count, 0))
        self.first[part] = np.minimum(first, least)

    def _give(self, d: np.ndarray, n: np.ndarray, columns: np.ndarray) -> None:
        """Supplemental rows take in their distances to some targets, n equal ones each."""
        column = d.min(axis=0)
        i, j = _marked(d == column)
        count = np.bincount(j, n[i], minlength=len(columns)).astype(np.int64)
        before = self.reverse[columns]
        self.reverse_ties[columns] = np.where(column < before, count, self.reverse_ties[columns] + np.where(column == before, count, 0))
        self.reverse[columns] = np.minimum(before, column)

    def end(self) -> dict | None:
        b = self.b
        if not self.with_reverse:
            return None
        return {"s_idx": b.members, "reverse": np.repeat(self.reverse, b.n), "reverse_ties": np.repeat(self.reverse_ties, b.n)}


class Counted:
    """As ``match._Counted`` without bins: near misses beside d1 (none where it is nan)."""

    SCHEMA = "t_idx array<long>, near array<long>"
    BATCH = 1 << 18

    def __init__(self, tile: list, threshold: float) -> None:
        self.tile, self.threshold = _Tile(tile), threshold

    def target(self, t_idx: np.ndarray, x: np.ndarray, d1: np.ndarray, *_) -> dict:
        # Rows that are equal have the same nearest distance, or none where it was not asked for.
        a = Leaves(t_idx, np.column_stack([x, np.where(d1 > 0, d1, np.nan)]), TARGET_LEAF)
        near = np.zeros(len(a.x), np.int64)
        a.x, own = np.ascontiguousarray(a.x[:, :-1]), a.x[:, -1].copy()
        for i in range(len(a)):
            rows = slice(a.start[i], a.start[i + 1])
            low, high = a.low[i, -1], a.high[i, -1]
            if np.isnan(low):
                continue
            b = self.tile.seen_by(a, i)
            with np.errstate(divide="ignore", invalid="ignore"):
                reached = high / _between(a, i, b, True) >= self.threshold
                whole = low / _between(a, i, b, False) >= self.threshold
            # All distances are at least the nearest one, which is above 0.
            near[rows] += b.weight[whole & reached].sum()
            columns = b.rows(np.flatnonzero(reached & ~whole))
            for part in blocks.slices(rows.stop - rows.start, len(columns)):
                part = slice(part.start + rows.start, part.stop + rows.start)
                d = blocks.distances(a.x[part], b.x[columns])
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit, j = _marked((d > 0) & (own[part, None] / d >= self.threshold))
                near[part] += np.bincount(hit, b.n[columns[j]], minlength=len(d)).astype(np.int64)
        return {"t_idx": t_idx, "near": near[a.place]}

    def end(self) -> None:
        return None


class Lists:
    """The k nearest rows of each target in a tile, ties by index: a row a target, empty lists where nothing is finite."""

    SCHEMA = "target_idx long, s_idx array<long>, d array<double>"
    BATCH = 1 << 17

    def __init__(self, tile: list, k: int) -> None:
        self.tile, self.k = _Tile(tile), k

    def target(self, t_idx: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = Leaves(t_idx, x, TARGET_LEAF)
        for i in range(len(a)):
            rows = slice(a.start[i], a.start[i + 1])
            own, s_idx, d = self._of_leaf(a, i)
            size = np.bincount(own, minlength=rows.stop - rows.start)
            start = np.cumsum(size) - size
            # Every member of a distinct row has its list.
            members = a.members[a.first[rows.start] : a.first[rows.start] + a.n[rows].sum()]
            place = np.repeat(np.arange(len(size)), a.n[rows])
            step = max(1, _LIST_CELLS // self.k)
            for k in range(0, len(members), step):
                p = place[k : k + step]
                ends = np.cumsum(size[p])
                at = np.repeat(start[p] - ends + size[p], size[p]) + np.arange(size[p].sum())
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[at])) for v in (s_idx, d)]
                yield pa.RecordBatch.from_arrays([pa.array(members[k : k + step]), *lists], ["target_idx", "s_idx", "d"])

    def _of_leaf(self, a: Leaves, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the leaf, index, distance) of the k nearest rows of each row of a leaf, in their order."""
        b, k = self.tile.seen_by(a, i), self.k
        rows = slice(a.start[i], a.start[i + 1])
        bound = _between(a, i, b, True)
        order = np.argsort(bound, kind="stable")
        enough = np.searchsorted(np.cumsum(b.weight[order]), k) + 1
        limit = self._limits(a.x[rows], b, b.rows(order[: max(enough, _FIRST_LEAVES)]))
        columns = b.rows(np.flatnonzero((bound <= limit.max()) & (bound < np.inf)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for part in blocks.slices(rows.stop - rows.start, len(columns)):
            if not len(columns):
                break
            d = blocks.distances(a.x[rows][part], b.x[columns])
            limit = self._cut(d, b.n[columns])
            row, j = np.nonzero((d <= limit[:, None]) & (d < np.inf))
            d, u = d[row, j], columns[j]
            n = np.minimum(b.n[u], k)  # of equal rows no more than k count
            at = np.repeat(b.first[u] - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, d, s_idx = np.repeat(row, n), np.repeat(d, n), b.members[at]
            by = np.lexsort((s_idx, d, row))
            row = row[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[keep] + part.start, s_idx[by][keep], d[by][keep]))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def _limits(self, x: np.ndarray, b: Leaves, columns: np.ndarray) -> np.ndarray:
        return np.concatenate([self._cut(blocks.distances(x[part], b.x[columns]), b.n[columns]) for part in blocks.slices(len(x), len(columns))])

    def _cut(self, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The k-th least distance of each row, equal columns counted n times; inf where there are fewer."""
        m = min(self.k, d.shape[1])
        some = np.argpartition(d, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(d, some, 1)
        by = np.argsort(near, axis=1)
        total = np.cumsum(np.take_along_axis(n[some], by, 1), axis=1)
        place = (total < self.k).sum(axis=1)
        return np.where(place < m, np.take_along_axis(np.take_along_axis(near, by, 1), np.minimum(place, m - 1)[:, None], 1)[:, 0], np.inf)

    def end(self) -> None:
        return None


class WithoutEach:
    """As ``match._WithoutEach``: the nearest row of each target without feature k, for all k."""

    SCHEMA = "t_idx array<long>, k array<long>, first array<double>, best array<long>"
    BATCH = 1 << 18

    def __init__(self, tile: list) -> None:
        width = tile[0][1].shape[1]
        self.searches = [Nearest([(i, np.delete(x, k, axis=1)) for i, x in tile], reverse=False) for k in range(width)]

    def target(self, t_idx: np.ndarray, x: np.ndarray) -> dict:
        found = [s.target(t_idx, np.delete(x, k, axis=1)) for k, s in enumerate(self.searches)]
        return {"t_idx": np.tile(t_idx, len(found)), "k": np.repeat(np.arange(len(found)), len(t_idx)), "first": np.concatenate([f["first"] for f in found]), "best": np.concatenate([f["best"] for f in found])}

    def end(self) -> None:
        return None
