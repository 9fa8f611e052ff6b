"""Jaccard join, line deduplication and components against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from pairwright.llm import jaccard_join, line_dedup, neighbours
from pairwright.llm.components import connected_components

from .common import Union, edited, frame, prose, rng, words


def sets(text, n=5):
    w = words(text)
    if not w:
        return frozenset([text or ""])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or frozenset([tuple(w)])


def brute_links(rows, threshold=0.8):
    s = {i: sets(t) for i, t in rows}
    up, n = Union(s), dict.fromkeys(s, 0)
    for a, b in itertools.combinations(s, 2):
        both = len(s[a] & s[b])
        if both >= threshold * (len(s[a]) + len(s[b]) - both) - 1e-9:
            up.join(a, b)
            n[a] += 1
            n[b] += 1
    return {i: (up.find(i), n[i]) for i in s}


def corpus():
    r = rng(5)
    base, other = prose(r, 120), prose(r, 300)
    texts = [base] * 6 + [edited(r, base, k % 4) for k in range(60)] + [edited(r, other, k % 3) for k in range(20)]
    texts += [prose(r, n) for n in (1, 2, 4, 5, 6, 50, 50, 400)] + ["one two", "One, two!", "", "", "...", None, prose(r, 6000)]
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk,small", [(256, 12), (8, 3)])
def test_links_and_classes_of_all_documents(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(neighbours, "CHUNK_NODES", chunk)
    monkeypatch.setattr(neighbours, "SMALL_BLOCK", small)
    rows = corpus()
    want = brute_links(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(frame(spark, rows)).collect()}
    assert got == want  # copies, links within a large group, ties, short, empty, null and long texts


def test_null_ids_repeats_clashing_columns_and_empty_tables(spark):
    text = prose(rng(2), 40)
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, "other words here", None), (1, "another text", "c")]
    docs = frame(spark, rows, "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0), (1, 1, 0)], key=str)
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, text), (1, "another text"), (None, text), (2, "other words here")], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0 and jaccard_join.representatives(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus()
    want = {root for root, _ in brute_links(rows).values()}
    assert {r["doc_id"] for r in jaccard_join.representatives(frame(spark, rows)).collect()} == want


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**jaccard_join.ROWS) ** jaccard_join.BANDS >= jaccard_join.RECALL
    assert 1 - (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS >= line_dedup.RECALL


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    up = Union({x for e in edges for x in e})
    for a, b in edges:
        up.join(a, b)
    got = {r["node"]: r["root"] for r in connected_components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {x: up.find(x) for x in up.up}
    assert connected_components(frame(spark, [], "a long, b long")).count() == 0


def brute_lines(rows):
    at, norm = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            x = " ".join(line.lower().split())
            if x:
                at.setdefault(x, []).append((i, k))
    for x in at:
        norm[x] = frozenset(x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)) or frozenset([x])
    up = Union(at)
    for a, b in itertools.combinations(at, 2):
        both = len(norm[a] & norm[b])
        if both and both >= 0.8 * (len(norm[a]) + len(norm[b]) - both) - 1e-9:
            up.join(a, b)
    first: dict = {}
    for x, places in at.items():
        first[up.find(x)] = min([first.get(up.find(x), (10**9, 0)), *places])
    stay = set(first.values())
    return {(i, k) for places in at.values() for i, k in places if (i, k) not in stay}


def test_one_line_of_each_group_stays(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL_BLOCK", 4)
    r = rng(9)
    shared, notice = prose(r, 60), prose(r, 12)
    rows = [(k, f"{prose(r, 20)}\n{shared if k % 2 else edited(r, shared, 1)}\n\n  \n{notice.upper() if k % 3 else notice}\nshort") for k in range(30)]
    rows += [(100, None), (101, ""), (102, f"{prose(r, 4000)}\n{shared}"), (103, "same\nsame\nsame")]
    got = {x["doc_id"]: x for x in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert {(i, k) for i, x in got.items() for k in x["removed_lines"]} == brute_lines(rows)
    assert got[100]["text"] is None and got[101]["text"] == "" and got[103]["text"] == "same"
    assert got[3]["text"].split("\n")[1:3] == ["", "  "]


def test_lines_keep_columns_and_null_ids(spark):
    rows = [(1, "a line of text here\nmore of the text", "x", 5), (None, "a line of text here\nits own line", "y", 5), (1, "a line of text here\nmore of the text", "x", 5)]
    docs = frame(spark, rows, "doc_id long, text string, keep string, n_chars long")
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((x["doc_id"], x["text"], x["keep"], x["n_chars"]) for x in out.collect()), key=str)
    # A null id comes first in the order, so its line stays; the repeated row is one document twice.
    assert got == sorted([(1, "more of the text", "x", 16), (None, "a line of text here\nits own line", "y", 5), (1, "more of the text", "x", 16)], key=str)
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0
    # What has lost all its lines goes; what was empty before stays.
    few = frame(spark, [(1, "a line of text here"), (2, "a line of text here\n "), (3, ""), (4, None)])
    assert {x["doc_id"] for x in line_dedup.without_repeats(few).collect()} == {1, 3, 4}


def test_recall_on_lines_at_the_threshold(spark):
    r = rng(4)
    rows, pairs = [], 0
    for k in range(150):
        line = prose(r, 60)
        other = edited(r, line, 2)
        rows += [(2 * k, line), (2 * k + 1, other)]
    want = brute_lines(rows)
    got = {(x["doc_id"], k) for x in line_dedup.deduplicate(frame(spark, rows)).collect() for k in x["removed_lines"]}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20 and pairs == 0


def test_one_edit_in_lines_of_usual_length(spark):
    notices = ["Copyright 2021 The Example Company. All rights reserved.", "Copyright 2022 The Example Company. All rights reserved."]
    words = [prose(rng(3), 16) + f" {w} and that is the end of it" for w in ("little", "modern")]
    other = ["Copyright 2021 Somebody Else, who may reserve no rights.", "Contact the office of the company by letter or telephone."]
    assert 50 <= len(notices[0]) < 98 and 94 <= len(words[0]) < 144
    got = line_dedup.deduplicate(frame(spark, list(enumerate([*notices, *words, *other])))).collect()
    assert {x["doc_id"] for x in got if x["removed_lines"]} == {1, 3}


def test_runs_are_characters():
    lines = ["straße über müller", "añb", "日本語の文書です", "plain text"]
    h, own = line_dedup.line_sets(pa.array(lines))
    for k, x in enumerate(lines):
        assert (own == k).sum() == max(1, len(x) - line_dedup.SHINGLE + 1)
    alone, _ = line_dedup.line_sets(pa.array([lines[3]]))
    assert set(alone) == set(h[own == 3])  # whatever stands beside it
    moved, _ = line_dedup.line_sets(pa.array(["é" + lines[0]]))
    assert set(h[own == 0]) < set(moved)


def test_repeated_rows_and_clashing_names(spark):
    row = "one line of text that comes again and again\none line of text that comes again and agaim"
    rows = [(7, row, "x")] * 400 + [(8, "one line of text that comes again and agai", "y")]
    docs = frame(spark, rows, "doc_id long, text string, n_lines string").repartition(5)
    out = line_dedup.deduplicate(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "removed_lines"]
    assert {(r["doc_id"], r["n_lines"], tuple(r["removed_lines"])) for r in out.collect()} == {(7, 2, (1,)), (8, 1, (0,))}
    assert line_dedup.without_repeats(docs).columns == docs.columns
    got = {(r["doc_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert got == {(7, 399), (8, 0)}


def test_white_space_beyond_ascii_is_text():
    """Keys and verification read the same text: no-break and ideographic spaces are characters of a line."""
    import pyarrow as pa

    lines = ["\u00a0\u00a0", "\u3000", "a\u00a0b", "a b", "a\u3000b"]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines)]), pa.array([[{"line": k, "node": k} for k in range(5)]])], ["text", "wanted"])
    (found,) = line_dedup._wanted_lines(iter([batch]))
    assert [x.decode() for x in found.column(1).to_pylist()] == lines


def test_lines_of_odd_spaces_stay_apart(spark):
    words = "the quick brown fox jumps over the lazy dog and runs away into the dark forest behind the old mill"
    rows = [(1, "\u00a0\u00a0"), (2, "\u3000"), (3, words), (4, words.replace(" ", "\u00a0"))]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: []}


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_keys_that_two_nodes_have_are_met_in_buckets(monkeypatch, pairs):
    """Pairs of keys and nodes travel as a few rows, not one by one, and those whose key another node has come out, however they are held."""
    monkeypatch.setattr(neighbours, "MET_PAIRS", pairs)
    g = np.random.default_rng(4)
    keys = neighbours.band_keys(g.integers(0, 40, (300, 3)).astype(np.uint64) << np.uint64(40))
    keys[:150] = neighbours.band_keys(g.integers(0, 1 << 62, (150, 3)).astype(np.uint64))
    lists = [None, [], *keys.tolist()]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["node", "keys"])
    dealt = pa.Table.from_batches(neighbours._dealt(iter([rows.slice(0, 100), rows.slice(100)]), 5))
    assert dealt.num_rows <= 10 and sum(map(len, dealt["keys"].to_pylist())) == keys.size * 8
    found = pa.Table.from_batches(neighbours._met_keys(iter(dealt.sort_by("bucket").to_batches(max_chunksize=3))))
    value, n = np.unique(keys, return_counts=True)
    often = set(value[n > 1].tolist())
    assert sorted(zip(*(found[c].to_pylist() for c in ("key", "node")), strict=True)) == sorted((k, v) for v, own in enumerate(lists) for k in own or () if k in often)


@pytest.mark.parametrize("m", [2, 5, 40])
def test_shared_counts_equal_those_of_plain_sets(m):
    g = np.random.default_rng(m)
    pool = g.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
    h, own = pool[g.integers(0, 60, m * 30)], np.repeat(np.arange(m), 30)
    sets = [set(h[own == k].tolist()) for k in range(m)]
    shared, size = neighbours.shared_counts(h, own, m)
    assert size.tolist() == [len(s) for s in sets]
    assert all(shared[a, b] == len(sets[a] & sets[b]) for a in range(m) for b in range(m) if a != b)
