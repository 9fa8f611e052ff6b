"""SimHash windows against a scan of all item-sized windows."""

from collections import Counter

import numpy as np

from pairwright.llm import decontaminate

from .common import edited, frame, prose, rng, words


def brute(docs, items):
    found = {}
    for i, text in docs:
        w = words(text)
        for item, passage in items:
            p = words(passage)
            if not p:
                continue
            n = min(5, len(p))
            want = Counter(tuple(p[k : k + n]) for k in range(len(p) - n + 1))
            best = 0.0
            for a in range(max(1, len(w) - len(p) + 1)):
                part = w[a : a + len(p)]
                have = Counter(tuple(part[k : k + n]) for k in range(len(part) - n + 1))
                both = sum((have & want).values())
                if both:
                    best = max(best, both / (sum(have.values()) + sum(want.values()) - both))
            if best >= 0.8 - 1e-9:
                found[i, item] = round(best, 6)
    return found


def tables():
    r = rng(3)
    items = [(k, prose(r, n)) for k, n in enumerate([3, 5, 8, 17, 30, 31, 44, 59, 300])] + [(20, ""), (21, None), (22, "...")]
    docs = []
    for k, (_, passage) in enumerate(items[:9]):
        docs.append((10 * k, f"{prose(r, 30)} {passage} {prose(r, 25)}"))
        docs.append((10 * k + 1, passage.upper().replace(" ", "  \n")))
        docs.append((10 * k + 2, f"{prose(r, 5)}, {edited(r, passage, 6)}"))
        docs.append((10 * k + 3, passage[: len(passage) // 3]))
    docs += [(500, None), (501, ""), (502, prose(r, 4000) + " " + items[6][1]), (503, prose(r, 20)), (None, items[5][1])]
    return docs, items


def test_finds_all_planted_items_and_nothing_else(spark):
    docs, items = tables()
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in got} == want
    assert all((10 * k + j, k) in want for k in range(9) for j in (0, 1)) and (502, 6) in want


def test_item_blocks_give_the_same(spark):
    docs, items = tables()
    a, b = frame(spark, docs), frame(spark, items + items[:3], "item_id long, text string")
    one = decontaminate.contaminated(a, b)
    many = decontaminate.contaminated(a, b, block_chars=100)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_clean_rows_stay_with_their_columns(spark):
    docs, items = tables()
    rows = [(i, t, "x") for i, t in docs]
    frame_ = frame(spark, rows, "doc_id long, text string, item_id string")
    kept = decontaminate.decontaminate(frame_, frame(spark, items, "item_id long, text string"), block_chars=500)
    dirty = {i for i, _ in brute(docs, items)}
    assert kept.columns == frame_.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - dirty
    none = frame(spark, [], "item_id long, text string")
    assert decontaminate.contaminated(frame_, none).count() == 0 and decontaminate.decontaminate(frame_, none).count() == len(rows)
    assert decontaminate.contaminated(frame_.limit(0), frame(spark, items, "item_id long, text string")).count() == 0


def test_index_finds_all_fingerprints_within_the_radius():
    r = np.random.default_rng(1)
    index = decontaminate.build([(k, prose(rng(k), 30)) for k in range(5)])[0]
    base = index.prints[r.integers(0, len(index.prints), 3000)]
    flips = r.integers(0, 20, 3000)
    near = base.copy()
    for k, n in enumerate(flips):
        for bit in r.choice(64, n, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    window, entry, distance = index.near(near)
    got = set(zip(window.tolist(), entry.tolist(), strict=True))
    want = {(k, e) for k in range(3000) for e in range(len(index.prints)) if bin(int(near[k] ^ index.prints[e])).count("1") <= decontaminate.RADIUS}
    assert got == want and all(bin(int(near[w] ^ index.prints[e])).count("1") == d for w, e, d in zip(window, entry, distance, strict=True))


def test_wide_windows_and_classes():
    assert [decontaminate.class_length(n) for n in (1, 2, 5, 10, 40)] == sorted(decontaminate.class_length(n) for n in (1, 2, 5, 10, 40))
    assert all(n / 1.3 <= decontaminate.class_length(n) <= n for n in range(1, 400))


def test_recall_by_similarity(spark):
    """Edited passages whose similarity is just above the threshold and higher, against the definition."""
    r = rng(17)
    items, docs = [], []
    for k in range(700):
        n = r.choice([40, 60, 90, 150, 260])
        items.append((k, prose(r, n)))
        docs.append((k, f"{prose(r, r.randrange(0, 60))} {edited(r, items[-1][1], max(0, round(n * r.choice([0, 0.005, 0.01, 0.015, 0.02, 0.025]))))} {prose(r, r.randrange(0, 60))}"))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    bins = {}
    for doc, item in zip(docs, items, strict=True):
        for pair, similarity in brute([doc], [item]).items():
            found, all_ = bins.get(min(int(similarity * 20), 19), (0, 0))
            bins[min(int(similarity * 20), 19)] = found + (pair in got), all_ + 1
    print({f"{k / 20:.2f}": f"{a}/{b}" for k, (a, b) in sorted(bins.items())})
    assert set(bins) == {16, 17, 18, 19} and all(b >= 25 and a >= 0.95 * b for a, b in bins.values())
    assert bins[19][0] == bins[19][1]
