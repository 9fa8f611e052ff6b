"""Ranges and histograms by leaves and lines against plain matrices, bit for bit, and how many pairs they look at."""

import numpy as np
import pytest

from pairwright.operators import blocks, histograms, leaves, match

from .test_leaves import tables


def on_lines(kind, d, n=160, m=900):
    """Tables whose features but the last have few values."""
    g = np.random.default_rng(d)
    a, b = g.normal(size=(n, d)), g.normal(size=(m, d))
    a[:, :-1], b[:, :-1] = np.rint(a[:, :-1]), np.rint(b[:, :-1])
    if kind == "grid":
        a, b = np.rint(4 * a), np.rint(4 * b)
    if kind == "near ties":
        a[:, -1], b[:, -1] = 1 + g.integers(-9, 9, n) * 2.0**-52, 1 + g.integers(-400, 400, m) * 2.0**-52
    if kind == "missing":
        a[g.random(a.shape) < 0.3], b[g.random(b.shape) < 0.2] = np.nan, np.nan
        a[3], b[5] = np.nan, np.nan
    if kind == "overflow":
        b[::7, -1] = g.choice([-1e200, 1e200, 1e160], len(b[::7]))
    if kind == "alone":
        b[:] = b[0]
        a[::2] = b[0]
    if kind == "far":  # half a unit is lost in the rounding of a range
        a[:, -1] *= 1e17
        b[:, -1] *= 1e17
        b[40:] = b[39]
    return np.arange(n)[::-1] + 100, a, np.arange(m) * 3, b


def both(tile, t_idx, a, bins, threshold=0.8):
    """(ranges, then near misses and counts by target) of plain matrices, and by leaves and lines."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain, own = match._Nearest(tile, False, True).target(t_idx, a), leaves.Nearest(tile, reverse=False, with_range=True).target(t_idx, a)
        low, high = (np.where(np.isfinite(plain[c]), plain[c], np.nan) for c in ("first", "high"))
        wide = np.where(low == high, 0.5, 0.0)
        out = []
        for kernel in (match._Counted(tile, False, threshold, bins), histograms.Binned(tile, threshold, bins)):
            for d1 in (low, np.full(len(a), np.nan)):
                rows = [r for batch in kernel.target(t_idx, a, d1, low - wide, high + wide) for r in batch.to_pylist()]
                out.append({r["target_idx"]: r for r in rows})
                assert len(rows) == len(a)
    return [(plain[c], own[c]) for c in ("first", "high")], out[:2], out[2:]


@pytest.mark.parametrize("kind", ["plain", "grid", "near ties", "missing", "overflow", "alone", "far"])
@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_lines_equal_plain_matrices_bit_for_bit(monkeypatch, kind, d):
    monkeypatch.setattr(histograms, "ROWS_PER_BIN", 0.5)
    monkeypatch.setattr(blocks, "MOST_CELLS", 500)
    t_idx, a, s_idx, b = on_lines(kind, d)
    searched = []
    below = histograms.Line.below
    monkeypatch.setattr(histograms.Line, "below", lambda self, *x: searched.append(1) or below(self, *x))
    for bins in (1, 7, 30):
        ranges, want, found = both([(s_idx[:300], b[:300]), (s_idx[300:], b[300:])], t_idx, a, bins)
        assert all(np.array_equal(x, y) for x, y in ranges) and want == found
    assert searched


@pytest.mark.parametrize("kind", ["plain", "ties", "copies", "near ties", "missing", "some missing", "overflow", "apart"])
@pytest.mark.parametrize("d", [1, 2, 4])
def test_any_tables_bit_for_bit(monkeypatch, kind, d):
    monkeypatch.setattr(blocks, "MOST_CELLS", 3000)
    monkeypatch.setattr(leaves, "TARGET_LEAF", 9)
    monkeypatch.setattr(leaves, "SUPPLEMENTAL_LEAF", 14)
    t_idx, a, s_idx, b = tables(kind, d)
    order = np.argsort(s_idx)
    s_idx, b = s_idx[order], b[order]
    ranges, want, found = both([(s_idx, b)], t_idx, a, 10)
    assert all(np.array_equal(x, y) for x, y in ranges) and want == found


def test_thresholds_are_the_least_distances_of_their_bins():
    g = np.random.default_rng(4)
    low = np.concatenate([g.random(300), np.ones(40), [-0.5, 0.0, 0.0, 1e17]])
    high = np.concatenate([low[:300] + g.random(300), 1 + np.arange(40) * 2.0**-52, [0.5, 5e-324, 1e-310, 1e17]])
    for bins in (1, 3, 30):
        t = histograms.thresholds(low, high, bins)
        assert t.shape == (len(low), bins) and np.isinf(t[:, -1]).all() and (t[:, 1:] >= t[:, :-1]).all()
        for k in range(1, bins):
            own = t[:, k - 1]
            has = np.isfinite(own)
            assert (histograms.bin_of(own[has], low[has], high[has], bins) >= k).all()
            before = np.nextafter(np.where(has, own, high), -np.inf)
            before = np.where(has, before, high)
            ok = before >= np.maximum(low, 0)
            assert (histograms.bin_of(before[ok], low[ok], high[ok], bins) < k).all()


def test_most_pairs_are_passed_over(monkeypatch):
    """Ranges and histograms of 4,000 targets on 60,000 rows of 25 lines, 5 % without a cell: either looked at all pairs before."""
    looked = []
    plain = blocks.distances
    monkeypatch.setattr(blocks, "distances", lambda a, b: looked.append(len(a) * len(b)) or plain(a, b))
    g = np.random.default_rng(1)
    a, b = (np.column_stack([g.random(n), g.integers(0, 25, n) / 25]) for n in (4_000, 60_000))
    a[::11, 0], a[::13, 1], b[::20, 0] = np.nan, np.nan, np.nan
    idx, tile = np.arange(len(a)), [(np.arange(len(b)), b)]
    found = leaves.Nearest(tile, reverse=False, with_range=True).target(idx, a)
    low, high = (np.where(np.isfinite(found[c]), found[c], np.nan) for c in ("first", "high"))
    rows = [r for batch in histograms.Binned(tile, 0.8, 30).target(idx, a, np.full(len(a), np.nan), low, high) for r in batch.column("n").to_pylist()]
    assert sum(looked) < len(a) * len(b) / 4
    assert all(sum(r) == 60_000 for r, x in zip(rows, a, strict=True) if not np.isnan(x).any())


def test_histograms_over_one_tile_and_several(spark, monkeypatch):
    g = np.random.default_rng(6)
    target, supp = (np.column_stack([g.random(n), g.integers(0, 3, n)]).tolist() for n in (3_000, 400))
    target[7][0], supp[11][0] = None, None
    t, s = (spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{k} long, x double, y double") for rows, k in ((target, "ti"), (supp, "si")))
    monkeypatch.setattr(histograms, "ROWS_PER_BIN", 2)
    found = []
    for fast, several in ((None, False), (None, True), (True, True)):
        if several:
            monkeypatch.setattr(blocks, "TILE_BYTES", 2_000)
            monkeypatch.setattr(blocks, "SUPPLEMENTAL_ROWS", 100)
        m = match.Matcher(t, "ti", s, "si", ["x", "y"], fast=fast)
        found.append(sorted(tuple(r) for r in m.histograms(12).collect()))
        assert m.one_tile != several
    assert found[0] == found[1] == found[2] and len(found[0]) == 3_000 * 12
    assert sum(r[2] for r in found[0]) == 3_000 * 400
