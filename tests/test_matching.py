"""Block matching against a plain restatement of the definitions, row by row."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest

from pairwright.operators import blocks, match, standardize
from pairwright.operators.match import Matcher
from pairwright.sources.shared import names_in, shared_folder


def distance(a, b):
    if not any(x is not None and y is not None for x, y in zip(a, b, strict=True)):
        return math.inf
    terms = [2.0 if x is None or y is None else (x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return math.sqrt(blocks.sum_terms(terms))


def expected(target, supp, threshold=0.8):
    out = {}
    for i, a in enumerate(target):
        d = [distance(a, b) for b in supp]
        first = min(d)
        if first == math.inf:
            out[i] = (None, None, None, 0, 1.0, 0, False)
            continue
        best, repeats, order = d.index(first), d.count(first), sorted(d)
        second = order[1] if len(order) > 1 else math.inf
        if len(order) == 1 or second == math.inf:
            nndr = 0.0
        elif first == 0:
            nndr = 1.0 if second == 0 else 0.0
        else:
            nndr = first / second
        near = (repeats - 1) if first == 0 else sum(first / x >= threshold for x in d) - 1
        if len(order) == 1 or second == math.inf:
            near = 0
        reverse = min(distance(t, supp[best]) for t in target)
        out[i] = (best, first, None if second == math.inf else second, repeats, nndr, near, first == reverse)
    return out


def run(spark, target, supp, threshold=0.8):
    d = len(target[0])
    names = [f"x{k}" for k in range(d)]
    kinds = ", ".join(f"{n} double" for n in names)
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(target)], f"ti long, {kinds}")
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(supp)], f"si long, {kinds}")
    return Matcher(t, "ti", s, "si", names, threshold)


def got(matcher):
    return {r["target_idx"]: (r["match_idx"], r["best_distance"], r["second_distance"], r["repeats"], r["nndr"], r["near_miss"], r["mnn_confirmed"]) for r in matcher.matches().collect()}


def table(rng, n, d, missing=0.15, grid=None):
    def cell():
        if rng.random() < missing:
            return None
        return float(rng.randrange(grid)) if grid else rng.gauss(0, 1)

    return [[cell() for _ in range(d)] for _ in range(n)]


@pytest.mark.parametrize("d,grid,sizes", [(3, 4, (40, 30)), (5, None, (30, 50)), (9, None, (20, 25)), (1, 3, (15, 12))])
def test_same_as_row_by_row(spark, monkeypatch, d, grid, sizes):
    rng = random.Random(d)
    target, supp = table(rng, sizes[0], d, grid=grid), table(rng, sizes[1], d, grid=grid)
    target[3] = [None] * d
    supp[5] = [None] * d
    want = expected(target, supp)
    assert got(run(spark, target, supp)) == want
    # The same, bit for bit, whatever the blocks are.
    monkeypatch.setattr(blocks, "TARGET_ROWS", 7)
    monkeypatch.setattr(blocks, "SUPPLEMENTAL_ROWS", 11)
    monkeypatch.setattr(blocks, "MOST_CELLS", 40)
    assert got(run(spark, target, supp)) == want


def test_one_supplemental_row(spark):
    found = got(run(spark, [[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0]]))
    assert found[0][4:6] == (0.0, 0) and found[1][4:6] == (0.0, 0) and found[1][2] is None


def test_coincidental_tie(spark):
    found = got(run(spark, [[0.0, 0.0]], [[3.0, 4.0], [5.0, 0.0], [9.0, 9.0]]))
    assert found[0][:4] == (0, 5.0, 5.0, 2)


def test_reverse_ties(spark):
    rows = run(spark, [[0.0, 0.0], [2.0, 0.0]], [[1.0, 0.0]]).matches().collect()
    assert all(r["mnn_confirmed"] and r["reverse_repeat_count"] == 2 for r in rows)


@pytest.mark.parametrize("bad", [0, 1.5, -1])
def test_threshold_is_checked(spark, bad):
    with pytest.raises(ValueError, match="threshold"):
        run(spark, [[1.0]], [[1.0]], bad)


def test_top_distances_and_histogram(spark, monkeypatch):
    rng = random.Random(3)
    target, supp = table(rng, 4, 3, 0), table(rng, 30, 3, 0)
    target.append([None] * 3)
    monkeypatch.setattr(blocks, "SUPPLEMENTAL_ROWS", 13)
    m = run(spark, target, supp)
    tops = {r["target_idx"]: r["top_k_distances"] for r in m.top_distances(5).collect()}
    bins: dict = {}
    for r in m.histograms(10).collect():
        bins.setdefault(r["target_idx"], {})[r["bin"]] = (r["count"], r["low"], r["high"])
    assert tops[4] == [] and 4 not in bins
    for i in range(4):
        d = sorted(distance(target[i], b) for b in supp)
        assert tops[i] == d[:5]
        count, edges = np.histogram(d, 10)
        assert [bins[i][k][0] for k in range(10)] == count.tolist()
        assert [bins[i][k][1] for k in range(10)] == edges[:-1].tolist()


@pytest.mark.parametrize("n", [1, 5, 7, 8, 9, 15, 16, 33, 64, 128])
def test_sum_order(n):
    x = np.random.default_rng(n).normal(size=n)
    assert blocks.sum_terms([float(v) for v in x]) == float(np.sum(x))


def test_pooled_scores(spark):
    a = spark.createDataFrame([(1.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    b = spark.createDataFrame([(2.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    scales = standardize.pooled_scales(a, b, ["a", "b", "c"])
    assert scales[0].mean == 2.0 and math.isclose(scales[0].deviation, math.sqrt(2 / 3))
    assert scales[1] == standardize.Scale(5.0, 1.0) and scales[2] == standardize.Scale(0.0, 1.0)
    z = [tuple(r) for r in standardize.standardized(a, ["a", "b", "c"], scales).collect()]
    assert z[1] == (None, 0.0, None)


def test_scale_warnings(spark):
    a = spark.createDataFrame([(-1.2, 1.0), (0.3, 1.0), (1.1, 1.0)], "a double, b double")
    b = spark.createDataFrame([(800.0, 1.0), (1500.0, 2.0), (2400.0, 3.0)], "a double, b double")
    found = standardize.scale_warnings(a, b, ["a", "b"])
    assert len(found) == 1 and "'a'" in found[0] and "50x" in found[0]
    assert standardize.scale_warnings(b, b, ["a", "b"]) == []


def test_near_miss_cutoff(spark):
    from pyspark.sql import functions as F

    from pairwright.functions.signals import near_miss_cutoff

    row = spark.createDataFrame([(2.0, [2.0, 3.0])], "d double, top array<double>")
    a, b = row.select(near_miss_cutoff(F.col("d"), F.col("top"), 0.8), near_miss_cutoff(F.col("d"), F.col("top"), 0)).first()
    assert (a, b) == (2.5, 3.0)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, master):
            self.sparkContext, self.values = SimpleNamespace(master=master), {}
            self.conf = SimpleNamespace(get=self.values.get, set=self.values.__setitem__)

    with pytest.raises(RuntimeError):
        shared_folder(Session("spark://host:7077"))
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.values["spark.checkpoint.dir"]
    given = Session("yarn")
    given.values["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_folder(given) == "hdfs:///shared"


def _engines(a, b, d1=None):
    """All that the plain matrices and the products give for two blocks cut in two."""
    s_idx, t_idx = np.arange(len(b)) * 3, np.arange(len(a)) + 100
    tile = [(s_idx[: len(b) // 2], b[: len(b) // 2]), (s_idx[len(b) // 2 :], b[len(b) // 2 :])]
    out = []
    for fast in (False, True):
        nearest = match._Nearest(tile, fast, True)
        found = [nearest.target(t_idx[:5], a[:5]), nearest.target(t_idx[5:], a[5:]), nearest.end()]
        first = np.concatenate([f["first"] for f in found[:2]])
        counted = match._Counted(tile, fast, 0.8, 0).target(t_idx, a, np.where(np.isfinite(first), first, np.nan), first, first)
        closest = match._Closest(tile, fast, 4).target(t_idx, a)
        out.append([*(f[k] for f in found for k in f), counted["near"], closest["t_idx"], closest["s_idx"], closest["d"]])
    return out


@pytest.mark.parametrize("kind", ["ties", "copies", "near ties", "missing", "outliers", "overflow", "denormal"])
@pytest.mark.parametrize("d", [1, 5, 9, 64])
def test_products_equal_plain_matrices_bit_for_bit(monkeypatch, kind, d):
    monkeypatch.setattr(blocks, "MOST_CELLS", 37)
    g = np.random.default_rng(d)
    a, b = g.normal(size=(23, d)), g.normal(size=(40, d))
    if kind in ("ties", "missing"):
        a, b = np.rint(a), np.rint(b)
    if kind == "copies":
        b[10:30] = b[:20]
        a[:8] = b[12:20]
    if kind == "near ties":  # distances that differ in the last places, or not at all
        b[1:] = b[0] + np.nextafter(0, 1, dtype=float) + g.integers(-2, 3, size=(39, d)) * 2.0**-52
        a[:] = b[0] + g.integers(-3, 4, size=(23, d)) * 2.0**-51
    if kind == "missing":
        a[g.random(a.shape) < 0.4], b[g.random(b.shape) < 0.4] = np.nan, np.nan
        a[3], b[5], b[30] = np.nan, np.nan, np.nan
    if kind == "outliers":
        a[2], b[7], b[8] = 1e9, 1e9, 1e9 + 1
    if kind == "overflow":
        a[2], b[7] = 1e200, -1e200
    if kind == "denormal":
        a, b = a * 1e-170, b * 1e-170
    with np.errstate(over="ignore"):
        plain, product = _engines(a, b)
    for x, y in zip(plain, product, strict=True):
        assert np.array_equal(x, y)


def test_wide_table_by_either_engine(spark):
    rng = random.Random(5)
    target, supp = table(rng, 40, 12, grid=3), table(rng, 60, 12, grid=3)
    names = [f"x{k}" for k in range(12)]
    kinds = ", ".join(f"{n} double" for n in names)
    t, s = spark.createDataFrame([(i, *r) for i, r in enumerate(target)], f"ti long, {kinds}"), spark.createDataFrame([(i, *r) for i, r in enumerate(supp)], f"si long, {kinds}")
    want = expected(target, supp)
    for fast in (True, False):
        assert got(Matcher(t, "ti", s, "si", names, fast=fast)) == want


def test_matches_and_histograms_in_two_passes(spark, monkeypatch):
    rng = random.Random(9)
    target, supp = table(rng, 30, 3, grid=4), table(rng, 25, 3, grid=4)
    target[4] = [None] * 3
    passes = []
    over = blocks.over_blocks
    monkeypatch.setattr(blocks, "over_blocks", lambda *a: passes.append(a) or over(*a))
    m = run(spark, target, supp)
    matches, bins = m.matches_and_histograms(10)
    assert {r["target_idx"]: (r["match_idx"], r["best_distance"], r["second_distance"], r["repeats"], r["nndr"], r["near_miss"], r["mnn_confirmed"]) for r in matches.collect()} == expected(target, supp)
    both = {(r["target_idx"], r["bin"]): (r["count"], r["low"], r["high"]) for r in bins.collect()}
    assert len(passes) == 2
    assert both == {(r["target_idx"], r["bin"]): (r["count"], r["low"], r["high"]) for r in run(spark, target, supp).histograms(10).collect()}
    assert all(k[0] != 4 for k in both) and len(both) == 29 * 10


def test_each_feature_left_out_in_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    for d in (2, 4, 10):
        target, supp = table(rng, 25, d, 0.3, grid=4), table(rng, 30, d, 0.3, grid=4)
        found = {(r["target_idx"], r["k"]): r["match_idx"] for r in run(spark, target, supp).without_each().collect()}
        cut = lambda rows, k: [r[:k] + r[k + 1 :] for r in rows]
        want = {(i, k): x[0] for k in range(d) for i, x in expected(cut(target, k), cut(supp, k)).items()}
        assert found == want
    with pytest.raises(ValueError, match="No shared columns"):
        run(spark, [[1.0]], [[1.0]]).without_each()


def test_tiles_move_few_bytes():
    def blocks_of(n, rows):
        return blocks.Blocks(None, -(-n // rows), n)

    for n_target, n_supp, width, cores in ((1_500_000, 1_000_000, 64, 8), (1_500_000, 1_000_000, 64, 1000), (100_000, 100_000, 64, 8), (50, 3, 2, 8), (10**9, 10**6, 5, 4000)):
        t, s = blocks_of(n_target, 2048), blocks_of(n_supp, max(64, min(16384, (1 << 18) // width)))
        tiles, groups = blocks.tiles_and_groups(t, s, width, cores)
        assert 1 <= tiles <= s.n and 1 <= groups <= t.n
        assert tiles == s.n or n_supp * width * 8 / tiles <= 1.01 * blocks.TILE_BYTES
        assert tiles * groups >= min(blocks.TASKS_PER_CORE * cores, t.n * s.n) * 0.4
        assert n_target * tiles + n_supp * groups <= n_target * s.n + n_supp * max(1, -(-3 * cores // s.n))


def test_kept_tables_go(spark):
    folder = shared_folder(spark)
    before = set(names_in(spark, folder))
    m = run(spark, [[1.0, 2.0], [2.0, 2.0]], [[1.0, 2.0], [1.5, 2.0]])
    assert len(m.matches().collect()) == 2 and set(names_in(spark, folder)) - before
    m.kept.forget()
    assert set(names_in(spark, folder)) == before


def test_all_distances_of_stated_targets(spark):
    rng = random.Random(12)
    target, supp = table(rng, 20, 3, 0.3, grid=3), table(rng, 45, 3, 0.3, grid=3)
    target[7] = [None] * 3
    got_ = {}
    for r in run(spark, target, supp).sorted_distances([3, 7, 11, 11, 999]).collect():
        got_.setdefault(r["target_idx"], []).append((r["supp_idx"], r["distance"]))
    assert sorted(got_) == [3, 7, 11]
    for t, found in got_.items():
        d = [distance(target[t], b) for b in supp]
        order = sorted(range(len(supp)), key=lambda j: (d[j], j))
        assert found == [(j, None if d[j] == math.inf else d[j]) for j in order]
