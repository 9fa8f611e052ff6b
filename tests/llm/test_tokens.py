"""Packing and token counts against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from pairwright.llm import packing, token_counts
from pairwright.llm.tokens import WordTokens, vocabulary_path

from .common import frame, prose, rng

ODD = [
    "it's 'stop' they'll DON'T x'y", "a.b,c;d 12 3.4e5 é.è À'É ß—ü “quoted” ¿qué? ...", "tab\tand\vline\nfeed\x1c\x85  end", "é ≠ İstanbul ΣΑΣ", "", "   ", "日本語テキスト。混在 text", "\x01 \x01a", "<|endoftext|> a <|startoftext|>",
    "emoji 🙂🙂 flags 🇩🇪", "<|ENDOFTEXT|>", "a" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def documents():
    r = rng(8)
    texts = ODD + [prose(r, n) for n in (1, 5, 40, 300, 9000)] + [prose(r, r.randrange(5, 900)) for _ in range(120)] + [None]
    return list(enumerate(texts))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    import pyarrow as pa

    from pairwright.llm import kernel

    fast = WordTokens(vocabulary_path("word_bpe_49k.json"))
    for _ in range(2):  # the second time from what is kept
        for _, text in documents():
            buf, offsets = kernel.utf8(pa.array([text or ""]))
            ids, at = fast.encode(buf, offsets)
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


def check_packing(rows, texts, tokenizer, capacity):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity,parts", [(4096, 1), (64, 3)])
def test_every_token_is_packed_once(spark, tokenizer, capacity, parts):
    rows = documents()
    got = packing.pack(frame(spark, rows).repartition(parts), capacity=capacity).collect()
    assert check_packing(got, dict(rows), tokenizer, capacity) == 0


def test_packing_edges(spark):
    rows = [(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "z")]
    got = packing.pack(frame(spark, rows, "doc_id long, text string, start string")).collect()
    assert sum(r["length"] for r in got) == 9 and sorted(str(r["doc_id"]) for r in got if r["start"] == 0) == ["1", "1", "None"]
    assert packing.pack(frame(spark, [])).count() == 0


def test_levels_keep_the_squares_small():
    packer = packing.LevelPacker(10, 0)
    packer.count[3], packer.count[5], packer.count[7] = 2, 1, 1
    # Level 3 goes from 2 to 1, which lowers the sum by 2; 7 + 3 closes a window, but lowers it by 1 only.
    assert packer.level(3) == 3

    def rise(g, s):
        after = packer.count[:10].copy()
        after[g] -= g > 0
        if g + s < 10:
            after[g + s] += 1
        return (after[1:] ** 2).sum() - (packer.count[1:10] ** 2).sum()

    for s in range(1, 11):
        options = {g: rise(g, s) for g in range(0, 11 - s) if g == 0 or packer.count[g] > 0}
        assert options[packer.level(s)] == min(options.values())
        assert packer.level(s) == max(g for g in options if options[g] == min(options.values()))  # ties: the fullest


class Plain:
    """Sum of squares by its definition: counts by level in a dict, every level tried; or best fit."""

    def __init__(self, capacity, best_fit=False):
        self.capacity, self.best_fit, self.count = capacity, best_fit, defaultdict(int)

    def place(self, size):
        def rise(g):
            change = (1 - 2 * self.count[g] if g else 0) + (2 * self.count[g + size] + 1 if g + size < self.capacity else 0)
            return (0 if self.best_fit else change, -g)

        g = min([0, *(g for g, n in self.count.items() if n and g + size <= self.capacity)], key=rise)
        if g:
            self.count[g] -= 1
        if g + size < self.capacity:
            self.count[g + size] += 1
        return g


def real_lengths(tokenizer):
    """Ids of the given documents, with the end id, and many more lengths of their kind."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    own = [len(e.ids) + 1 for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    g = np.random.default_rng(1)
    return own + [max(1, int(n * f)) for n, f in zip(g.choice(own, 10_000), g.uniform(0.5, 1.5, 10_000), strict=True)]


def test_placements_are_those_of_the_sum_of_squares(tokenizer):
    packer, plain, fit, other = packing.LevelPacker(4096, 0), Plain(4096), Plain(4096, best_fit=True), 0
    lengths = real_lengths(tokenizer)
    for k, n in enumerate(lengths):
        rest = n % 4096
        if rest:
            want = plain.place(rest)
            assert packer.level(rest) == want, (k, n)
            other += want != fit.place(rest)
        packer.add(k, np.zeros(n, np.uint32))
    assert packer.n_open == sum(plain.count.values()) and other > 0.2 * len(lengths)  # best fit places otherwise
    placed = packer.sequence
    packer.finish()
    assert packer.n_open == 0
    # What is left to the end is a small share of a partition of usual size.
    assert packer.sequence - placed <= 0.2 * packer.sequence, (placed, packer.sequence)
    print(len(lengths), placed, packer.sequence)


def test_only_open_windows_are_held():
    r, packer = np.random.default_rng(3), packing.LevelPacker(4096, 0)
    for k, n in enumerate(r.lognormal(5.5, 1.2, 4000).astype(int) + 1):
        packer.add(k, np.zeros(n, np.uint32))
        assert packer.n_open == sum(len(x) for x in packer.open.values()) == packer.count[1:4096].sum()
    assert packer.n_open < 700


@pytest.mark.parametrize("block,group", [(7, 2), (1000, 3), (1 << 17, 1024)])
def test_counts_across_blocks(spark, tokenizer, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "SCAN_GROUP", group)
    tokenizer.encode_special_tokens = True
    rows = documents()
    blocks, order = token_counts.write_token_files(frame(spark, rows).repartition(3), block_tokens=block)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(blocks).join(order, ["file", "ordinal"]).collect()}
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    tokenizer.encode_special_tokens = False
    assert got == want


def test_raw_files_and_unfinished_documents(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9, 1, 2, 3], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([9], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block_tokens=2)
    got = sorted((r["file"][-5], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in token_counts.count_tokens(blocks, end_id=9).collect())
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True), ("a", 3, 6, 3, False), ("b", 0, 0, 0, True)]


def test_counts_of_odd_tables(spark):
    rows = [(None, None, "x"), (1, "a b", "y"), (1, "a b", "y")]
    got = token_counts.document_counts(frame(spark, rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 2), ("1", 2), ("None", 0)]
    assert token_counts.document_counts(frame(spark, [])).count() == 0
