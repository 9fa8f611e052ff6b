"""Near-duplicate vectors, whitening and the prefix trie against plain restatements."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pairwright.llm import prefix_trie, vector_near, whitening

from .common import Union, rng

NEAR = "vec_id long, embedding array<double>, label int"


def near(v, cosine, g):
    """A vector at the given cosine to v."""
    v = v / np.linalg.norm(v)
    z = g.standard_normal(len(v))
    z -= (z @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def brute_links(rows, threshold=vector_near.THRESHOLD):
    def sound(v, label):
        return label is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

    ok = [k for k, (_, v, label) in enumerate(rows) if sound(v, label)]
    union, links = Union(range(len(rows))), [0] * len(rows)
    for x, a in enumerate(ok):
        for b in ok[x + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1], float), np.array(rows[b][1], float)
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    union.join(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[union.find(k)] = min(least.get(union.find(k), r[0]), r[0])
    out = []
    for k, r in enumerate(rows):
        c = least.get(union.find(k))
        out.append((r[0], links[k], c, r[0] is not None and r[0] == c))
    return sorted(out, key=repr)


def got_links(spark, rows, schema=NEAR):
    return sorted((tuple(r) for r in vector_near.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_links_and_components_equal_brute_force(spark):
    g, rows = np.random.default_rng(3), []
    for k in range(120):
        v = g.standard_normal(64)
        rows.append((len(rows), v.tolist(), k % 2))
        for c in (0.9999, 0.99, 0.981, 0.979, 0.95)[: k % 6]:
            rows.append((len(rows), (near(v, c, g) * 3).tolist(), k % 2))
    chain = g.standard_normal(64)
    for _ in range(12):  # a path of links whose ends are far apart
        rows.append((len(rows), chain.tolist(), 0))
        chain = near(chain, 0.985, g)
    rows += [(len(rows) + k, rows[7][1], rows[7][2]) for k in range(5)]  # copies
    rows += [(1000, rows[7][1], 1 - rows[7][2]), (1000, rows[7][1], rows[7][2]), (None, rows[9][1], rows[9][2])]
    assert got_links(spark, rows) == brute_links(rows)


def test_odd_vectors_have_defined_results(spark):
    one = [1.0, 2.0, 2.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [1.0, math.nan, 2.0], 1), (6, [math.inf, 1.0, 1.0], 1), (7, one, None), (7, one, None),
        (8, one, 1), (9, [1e300, 2e300, 2e300], 1), (10, [1e-300, 2e-300, 2e-300], 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -2.0], 1), (13, [2.5], 1), (14, [0.1], 1), (15, [-0.1], 1), (None, None, None),
    ]
    assert got_links(spark, rows) == brute_links(rows)
    assert got_links(spark, []) == []
    extra = spark.createDataFrame([(1, one, 1, 5, "x"), (2, one, 1, 6, "y")], "vec_id long, embedding array<float>, label int, node long, key string")
    assert sorted(map(tuple, vector_near.near_vectors(extra).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_large_group_is_cut_and_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_near, "CHUNK_NODES", 16)
    g = np.random.default_rng(5)
    v = g.standard_normal(32)
    rows = [(k, near(v, 0.995 if k % 3 else 0.985, g).tolist(), 4) for k in range(150)]
    assert got_links(spark, rows) == brute_links(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above it are all found, in few and in many dimensions."""
    g, rows = np.random.default_rng(8), []
    for d in (3, 24, 64, 200):
        for _ in range(250):
            v = g.standard_normal(d)
            rows += [(len(rows), v.tolist(), 1), (len(rows) + 1, near(v, 0.9801, g).tolist(), 1)]
    links = {r[0]: r[1] for r in got_links(spark, rows)}
    assert sum(links[k] > 0 for k in range(len(rows))) >= 0.999 * len(rows)


def test_windows_and_counts_are_calibrated():
    assert vector_near.least_count(24) == 23 and vector_near.least_count(1) == 1
    assert vector_near.rotations_for(1000, 64) == 2 and vector_near.rotations_for(1_000_000, 64) == 3
    assert vector_near.groups_for(64, 3) > vector_near.groups_for(64, 2) > 1


# Whitening -----------------------------------------------------------------------------------


def brute_whitened(rows, components=16, weights="one"):
    rows = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    xs = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in rows]
    fit = [list(x) for x in {tuple(x): None for x in xs}] if weights == "one" else xs
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    z = np.array([[float(v - s[k] / n) for k, v in enumerate(x)] for x in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for r, x in zip(rows, xs, strict=True):
        y = (np.array(x, float) - np.array(s) / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        for k in range(min(components, d)):
            out.setdefault((r[0], k + 1), []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), abs(y[k]), e[k] / np.trace(v)))
    return out


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_its_definition(spark, weights):
    g = np.random.default_rng(2)
    turn = g.standard_normal((20, 20))
    rows = [(k, (g.standard_normal(20) @ turn).tolist()) for k in range(300)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(50)] + [(None, rows[0][1]), (2000, None), (2001, [1.0, None] * 10), (2002, [math.nan] * 20), (2003, [1.0, 2.0]), (2004, [])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weights=weights).collect()
    want = brute_whitened([r for r in rows if not (r[1] and len(r[1]) == 2)], weights=weights)
    assert len(got) == 351 * 16
    for r in got:
        n, deviation, size, share = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-8) and r["explained"] == pytest.approx(share, rel=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-9
    by = defaultdict(dict)
    for r in got:
        if r["vec_id"] is not None and (weights == "counts" or r["vec_id"] < 300):
            by[r["vec_id"]][r["component"]] = r["whitened"]
    if weights == "one":
        y = np.array([[row[k + 1] for k in range(16)] for row in by.values()])
        assert np.abs(y.T @ y / len(y) - np.eye(16)).max() < 1e-9  # signs agree in all rows


def test_whitening_of_little_and_of_odd_tables(spark):
    def run(rows, kind="array<float>"):
        return whitening.whiten(spark.createDataFrame(rows, f"vec_id long, embedding {kind}, x long, copies int"), 16).collect()

    assert run([]) == [] and run([(1, None, 0, 0)]) == [] and run([(1, [], 0, 0)]) == []
    assert run([(1, [1.0, 2.0], 0, 0)] * 3) == []  # no variance
    two = run([(1, [0.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0), (2, [1.0, 0.0], 0, 0)])
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], round(r["whitened"], 9)) for r in two) == [(1, 1, 2, 64 * 64, -1.0), (2, 1, 2, 64 * 64, 1.0), (2, 1, 2, 64 * 64, 1.0)]
    huge = run([(k, [float(k) * 1e14, 1.0 * (k % 2)], 0, 0) for k in range(5)], "array<double>")
    assert {(r["vec_id"], r["deviation"]) for r in huge} == {(k, (5 * 64 * (k % 2) - 128) ** 2 if k == 2 else None) for k in range(5)}  # the others are beyond a long


def test_deviations_are_exact():
    x = np.array([[3, 5], [10**6, -(10**6)], [2**40, 7]])
    c = whitening.Centre(3, [int(s) for s in x.sum(axis=0)])
    assert c.deviations(x) == [s if (s := sum((3 * int(v) - t) ** 2 for v, t in zip(row, c.sums, strict=True))) < 2**63 else None for row in x]
    assert np.allclose(c.centred(x), x - np.array(c.sums) / 3)


# The prefix trie -----------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    for p, cs in members.items():
        sub = list(below(p))
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in sub if q)
        ends = sorted(c for c in cs if len(rebuilt[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in sub), saved, digest))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def got_trie(spark, rows, schema=TURNS):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(spark.createDataFrame(rows, schema)).collect()), key=repr)


def conversations(r, n):
    rows = []
    for c in range(n):
        text = lambda: r.choice(["hello there", "a b  c", "", None, "one\ttwo\nthree", "Ünï cödé x"])
        ids = c if r.random() < 0.9 else -c
        for t in r.sample(range(12), r.randrange(0, 9)):
            rows.append((ids, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), text()))
    seen = {}
    return [x for x in rows if seen.setdefault((x[0], x[1]), x) is x]  # no ties


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 50)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = conversations(rng(4), 160)
    rows += [(1000 + k, t, "user", f"shared {t}") for k in range(60) for t in range(5)]
    rows += [(None, 1, "user", "nowhere"), (2**62, 0, "user", "x")]
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_of_given_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(spark, rows) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert got_trie(spark, []) == [] and got_trie(spark, [(None, 0, "user", "x")]) == []
    long = [(20, t, "user", f"turn {t} " + "w " * (t % 3)) for t in range(700)]  # one long conversation, and one that ends where it does
    assert got_trie(spark, long + [(40, 0, None, None)]) == brute_trie(long + [(40, 0, None, None)])
    twice = [(60, 1, "user", "x"), (60, 1, "user", "x"), (60, 1, "user", "x"), (60, 1, "user", "x")]  # repeated rows
    assert got_trie(spark, twice) == brute_trie(twice)
    extra = spark.createDataFrame([(60, 1, "user", "x", 3, "y")], TURNS + ", depth int, d1 string")
    assert len(prefix_trie.prefix_nodes(extra).collect()) == 2
    ties = [(80, 1, "user", x) for x in "abcdef"]  # the order of rows says nothing
    assert got_trie(spark, ties) == got_trie(spark, ties[::-1])


def test_slots_are_perfect_and_checked():
    g = np.random.default_rng(1)
    keys = np.unique(g.integers(-(2**63), 2**63 - 1, 5000))
    other = np.arange(len(keys))
    slots = prefix_trie.PerfectSlots(keys, other)
    assert sorted(slots(keys, other)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        slots(keys[:1], other[:1] + 1)
    with pytest.raises(ValueError):
        prefix_trie.PerfectSlots(keys[[0, 0]], other[[0, 0]])
