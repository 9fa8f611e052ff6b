"""The search by leaves against plain matrices, bit for bit, and how many pairs it looks at."""

import numpy as np
import pytest

from pairwright.operators import blocks, leaves, match


def tables(kind, d, n=300, m=500):
    g = np.random.default_rng(d)
    a, b = g.normal(size=(n, d)), g.normal(size=(m, d))
    if kind in ("ties", "missing"):
        a, b = np.rint(2 * a), np.rint(2 * b)
    if kind == "copies":
        b[100:] = b[g.integers(0, 100, m - 100)]
        a[:150] = b[g.integers(0, m, 150)]
    if kind == "near ties":
        b[1:] = b[0] + g.integers(-2, 3, size=(m - 1, d)) * 2.0**-52
        a[:] = b[0] + g.integers(-3, 4, size=(n, d)) * 2.0**-51
    if kind in ("missing", "some missing"):
        a[g.random(a.shape) < 0.3], b[g.random(b.shape) < 0.3] = np.nan, np.nan
        a[3], b[5], b[30] = np.nan, np.nan, np.nan
    if kind == "overflow":
        a[2], b[7] = 1e200, -1e200
    if kind == "apart":  # targets in one corner: most supplemental rows are nobody's nearest
        a = a * 0.01 + 5
    return np.arange(n)[::-1] + 100, a, g.permutation(m) * 3, b


def by_target(found, *columns):
    order = np.argsort(found["t_idx"])
    return [found[c][order] for c in columns]


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "near ties", "missing", "some missing", "overflow", "apart"])
@pytest.mark.parametrize("d", [1, 2, 4])
def test_leaves_equal_plain_matrices_bit_for_bit(monkeypatch, kind, d):
    monkeypatch.setattr(blocks, "MOST_CELLS", 200)
    monkeypatch.setattr(leaves, "TARGET_LEAF", 9)
    monkeypatch.setattr(leaves, "SUPPLEMENTAL_LEAF", 14)
    t_idx, a, s_idx, b = tables(kind, d)
    order = np.argsort(s_idx)
    s_idx, b = s_idx[order], b[order]  # rows of a block ascend by index
    tile = [(s_idx[:200], b[:200]), (s_idx[200:], b[200:])]
    with np.errstate(over="ignore"):
        plain, own = match._Nearest(tile, False, False), leaves.Nearest(tile)
        parts = [slice(0, 170), slice(170, None)]
        want, found = ({k: np.concatenate([r[k] for r in rows]) for k in ("t_idx", "first", "second", "best", "ties")} for rows in ([k.target(t_idx[p], a[p]) for p in parts] for k in (plain, own)))
        finite = np.isfinite(want["first"])
        assert np.array_equal(want["first"], found["first"]) and np.array_equal(np.where(finite, want["second"], np.inf), found["second"])
        assert all(np.array_equal(want[c][finite], found[c][finite]) for c in ("best", "ties"))
        r, s = plain.end(), own.end()
        order = np.argsort(s["s_idx"])
        assert np.array_equal(r["s_idx"], s["s_idx"][order]) and np.array_equal(r["reverse"], s["reverse"][order])
        finite = np.isfinite(r["reverse"])
        assert np.array_equal(r["reverse_ties"][finite], s["reverse_ties"][order][finite])
        for threshold in (0.8, 0.3, 1.0):
            d1 = np.where(np.isfinite(want["first"]), want["first"], np.nan)
            near = [k.target(t_idx, a, d1, d1, d1)["near"] for k in (match._Counted(tile, False, threshold, 0), leaves.Counted(tile, threshold))]
            assert np.array_equal(*near)
        for k in (1, 7, 60, 1000):
            rows = {t: (s, v) for batch in leaves.Lists(tile, k).target(t_idx, a) for t, s, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            same = {t: (s, v) for batch in match._Lists(tile, False, k).target(t_idx, a) for t, s, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            assert rows == same and len(rows) == len(t_idx)
        if d > 1:
            x, y = match._WithoutEach(tile).target(t_idx, a), leaves.WithoutEach(tile).target(t_idx, a)
            finite = np.isfinite(x["first"])
            assert np.array_equal(x["first"], y["first"]) and np.array_equal(x["k"], y["k"]) and np.array_equal(x["best"][finite], y["best"][finite])


@pytest.mark.parametrize("rows,copies", [(20_000, 1), (1_000, 20)])
def test_most_pairs_are_passed_over(monkeypatch, rows, copies):
    """Nearest rows, near misses and lists of 20,000 x 20,000 rows: all pairs would be 400 million each."""
    looked = []
    plain = blocks.distances
    monkeypatch.setattr(blocks, "distances", lambda a, b: looked.append(len(a) * len(b)) or plain(a, b))
    g = np.random.default_rng(1)
    a, b = (np.tile(g.random((rows, 2)), (copies, 1)) for _ in range(2))
    idx = np.arange(len(a))
    tile = [(idx, b)]
    first = leaves.Nearest(tile).target(idx, a)["first"]
    leaves.Counted(tile, 0.8).target(idx, a, first)
    assert len([batch for batch in leaves.Lists(tile, 50).target(idx, a)]) and sum(looked) < 3 * 20_000 * 20_000 / 15


def test_targets_that_miss_a_cell_pass_over_most_pairs_too(monkeypatch):
    """Nearest rows, near misses and lists of 20,000 x 40,000 rows, where a third of the targets miss a cell."""
    looked = []
    plain = blocks.distances
    monkeypatch.setattr(blocks, "distances", lambda a, b: looked.append(len(a) * len(b)) or plain(a, b))
    g = np.random.default_rng(2)
    a, b = g.normal(size=(20_000, 2)), g.normal(size=(40_000, 2))
    a[::3, 1] = np.nan
    idx, tile = np.arange(len(a)), [(np.arange(len(b)), b)]
    first = leaves.Nearest(tile).target(idx, a)["first"]
    own = np.flatnonzero(np.isnan(a[:, 1]))
    leaves.Counted(tile, 0.8).target(own, a[own], first[own])
    assert len([batch for batch in leaves.Lists(tile, 50).target(own, a[own])]) and sum(looked) < 20_000 * 40_000 / 8
