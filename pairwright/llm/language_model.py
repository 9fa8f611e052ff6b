"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the runs of bytes other than ASCII white space of the text with A-Z lower-cased,
and one end token a text.  A token's class is its own if it is among the ``OWN_CLASSES`` most
frequent, else it comes from a hash of its last letters and of whether a sentence mark follows
them.  The probability of a token is that of its class given the context, times that of the
token given its class and the context; both are softmaxes:

* class: over weights of hashed features - the word before, the two before (an n-gram), the
  second before and the class of the third before (skips);
* token in class: over log q plus the weights of two features with the token: the two words before
  (an n-gram) and the second before (a skip).  q = (c + 0.5) / (N + 0.5 (V + 1)) over the training
  tokens of the class, so all unknown tokens of a class share one place.

The class weights take one pass over the training texts in ``ROUNDS`` rounds, each over its share
of the texts: every partition takes Adagrad steps from common weights, and the updates are
averaged feature by feature, weighted by how often each was touched, in a tree of ``FAN_IN``.  So
they depend on how the input is split.

The weights within a class are a table that grows with the training tokens: its shards are
counted, trained, kept and asked by shuffles.  A shard is chosen by the second word before, so a task
has all n-gram contexts of its skip contexts and trains both kinds of weights together: they start
from counts and take ``STEPS`` gradient updates over all training tokens of the shard, each divided
by twice the weight's count (a token has two features).  A weight of n tokens has the gradient n -
PENALTY - E, E the tokens that the model expects.  A weight is kept if it is positive at its start
and raises the log likelihood by ``LEAST_GAIN`` there, what it takes from other tokens included, n-grams
against the skip alone; the others are 0.  A word that comes more than ``SHARD_TOKENS`` times counts as several skip contexts, by the word
after it, so that no skip context is without bound.

Counts of all tokens are gathered by a shuffle; only the ``TOP_TOKENS`` most frequent ones are
broadcast and can have weights within a class; others reach their texts by a join.  Texts are read whole.

Tokens and contexts are known by hashes.  Nulls: a null text counts as empty (its one token is the
end); a row with a null doc_id is scored but not trained on, and its held_out is null.  Repeated rows
count each, an empty table gives no rows, and columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, labelled
from .store import written

HELD_OUT = 1
TOP_TOKENS = 1 << 17
OWN_CLASSES = 15
ENDINGS = 8
END_CLASS = OWN_CLASSES
CLASSES = OWN_CLASSES + 1 + 2 * ENDINGS
BUCKETS = 1 << 13
ROUNDS = 2
BATCH_TOKENS = 1 << 12
RATE = 0.5
#: Distinct tokens that a counting task holds before it passes them on.
MOST_HELD = 1 << 20
BLOCK_ROWS = 1024
FAN_IN = 16
PENALTY = 1.0
LEAST_GAIN = 3.0
STEPS = 8
#: Training tokens for each shard of the n-gram table, on average.
SHARD_TOKENS = 1 << 20
#: Skip contexts with this share of the training tokens, at most as many as its inverse, are in ``SALTS`` shards.
HOT_SHARE = 1 / 1024
SALTS = 16
#: Keys that a task holds before it passes them on.
HELD_KEYS = 1 << 21
#: Documents whose keys are passed on together, at most, and keys of one document in a run; both are 16-bit numbers.
MOST_DOCUMENTS = (1 << 16) - 1

_U64 = np.uint64
END = kernel.mix(np.array([3], _U64))[0]
START = kernel.mix(np.array([5], _U64))[0]
START_CLASS = CLASSES
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True

#: Rows of the weight table: the bias, three hashed features and one of classes.
_BIAS = 0
_WORDS = 1
_SKIPS = 1 + 3 * BUCKETS
ROWS = _SKIPS + CLASSES + 1
#: The last bits of an n-gram's key are the token's place in the vocabulary and 1, or 0 for all tokens of the context.
_ID_BITS = _U64(18)
_IDS = _U64((1 << 18) - 1)
#: Before them 22 bits of the n-gram context, 0 for the skip alone; 4 bits of the class and 20 of the skip context come first.
_CONTEXT_BITS = 22
_SKIP_BITS = _U64(18 + _CONTEXT_BITS)
_WITHIN = _U64((1 << (18 + _CONTEXT_BITS)) - 1)


def tokenize(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end token after each row, their ending classes, and row bounds."""
    buf = kernel.LOWER[buf]
    start, end, rows = kernel.spans(buf, offsets, kernel.NOT_SPACE)
    h = kernel.hash_spans(buf, start, end)
    n = len(offsets) - 1
    bounds = kernel.row_bounds(rows, n)
    cut = end.copy()
    for _ in range(3):
        cut -= (cut > start + 1) & _MARKS[buf[cut - 1]]
    last = buf[cut - 1].astype(_U64) if len(cut) else np.zeros(0, _U64)
    before = np.where(cut - 2 >= start, buf[np.maximum(cut - 2, 0)], 0).astype(_U64) if len(cut) else last
    ending = (kernel.mix(last * _U64(256) + before) % _U64(ENDINGS)).astype(np.int16)
    kind = OWN_CLASSES + 1 + 2 * ending + (cut < end)
    ends = bounds[1:]
    return np.insert(h, ends, END), np.insert(kind.astype(np.int16), ends, END_CLASS), bounds + np.arange(n + 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, n) of training texts, each token once for every so many."""
    held: list[tuple] = []
    size = 0

    def merged() -> tuple:
        h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return distinct, kind[first], np.bincount(inverse, n).astype(np.int64)

    def out(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kernel.signed(x[0])), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["token", "kind", "n"])

    for batch in batches:
        buf, offsets = kernel.utf8(batch.column(0))
        for a, b in kernel.chunks(offsets):
            h, kind, _ = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            distinct, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((distinct, kind[first], n))
            size += len(distinct)
            if size > MOST_HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > MOST_HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(merged())


def _parts(count: np.ndarray) -> np.ndarray:
    """The number of skip contexts, a power of two, of words with these counts, less 1."""
    return (2 ** np.ceil(np.log2(np.maximum(count / SHARD_TOKENS, 1))) - 1).astype(_U64)


@dataclass
class Vocabulary:
    """The most frequent tokens, sorted by hash, and figures of the classes."""

    token: np.ndarray
    count: np.ndarray
    kind: np.ndarray  # the class of each
    class_tokens: np.ndarray  # N by class, own classes: their count
    class_place: np.ndarray  # log10 of N + 0.5 (V + 1) by class; 0 where a class is one token
    n_tokens: int
    n_distinct: int

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.token & _U64(0xFFFFF)] = True
        self.log_count = np.log10(self.count + 0.5)
        self.parts = _parts(self.count)
        self.start_parts = _parts(self.count[self.token == END].sum(keepdims=True))[0]
        self.log_place = float(np.log10(self.n_tokens + 0.5 * (self.n_distinct + 1)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each token, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.token):
            maybe = np.flatnonzero(self.seen[h & _U64(0xFFFFF)])
            at = np.minimum(np.searchsorted(self.token, h[maybe]), len(self.token) - 1)
            out[maybe] = np.where(self.token[at] == h[maybe], at, -1)
        return out

    def classes(self, place: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return kind.astype(np.int64)
        return np.where(place >= 0, self.kind[place], kind).astype(np.int64)

    def share(self, place: np.ndarray) -> np.ndarray:
        """q: the share of each of its class."""
        return 10 ** (self.log_count[place] - self.class_place[self.kind[place]])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (token, kind, c), each token once."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Counts by sixteenths of their binary logarithm: a few hundred groups, from which a least count for the top follows.
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    groups = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.min("c").alias("least")).collect()
    least, taken = None, 0
    for r in sorted(groups, key=lambda r: -r["level"]):
        taken += r["v"]
        if taken > TOP_TOKENS:
            break
        least = r["least"]
    rows = counts.filter(F.lit(False) if least is None else F.col("c") >= least).toPandas()  # at most TOP_TOKENS
    top = rows.sort_values(["c", "token"], ascending=[False, True], ignore_index=True)
    words = top[top["kind"] != END_CLASS].head(OWN_CLASSES)
    ends = int(np.int64(END.astype(np.int64)))
    if total["n"] and ends not in set(top["token"]):  # the end token is always among them
        top = pd.concat([top, counts.filter(F.col("kind") == END_CLASS).toPandas()], ignore_index=True)
    own = {int(t): k for k, t in enumerate(words["token"])}
    by_class = np.zeros((CLASSES, 2))
    for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # a row a class
        by_class[r["kind"]] = r["n"], r["v"]
    for k, (kind, c) in enumerate(zip(words["kind"], words["c"], strict=True)):
        by_class[kind] -= c, 1
        by_class[k] = c, 1
    place = np.log10(by_class[:, 0] + 0.5 * (by_class[:, 1] + 1))
    place[: OWN_CLASSES + 1] = 0
    token = top["token"].to_numpy(np.int64).view(_U64)
    order = np.argsort(token)
    kind = np.array([own.get(int(t), k) for t, k in zip(top["token"], top["kind"], strict=True)], np.int64)
    return Vocabulary(token[order], top["c"].to_numpy(np.int64)[order], kind[order], by_class[:, 0], place, int(total["n"]), int(total["v"]))


def contexts(h: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, 4) rows of the weight table for each token's features, and a hash of the two words before."""
    n = len(h)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))

    def before(x: np.ndarray, k: int, start) -> np.ndarray:
        out = np.full(n, start, x.dtype)
        out[k:] = x[: n - k] if n > k else out[k:]
        out[place < k] = start
        return out

    one, two = before(h, 1, START), before(h, 2, START)
    both = kernel.mix(one * _U64(3) + two)
    top = _U64(64 - 13)
    rows = np.empty((n, 4), np.int64)
    rows[:, 0] = _WORDS + (one >> top).astype(np.int64)
    rows[:, 1] = _WORDS + BUCKETS + (both >> top).astype(np.int64)
    rows[:, 2] = _WORDS + 2 * BUCKETS + (two >> top).astype(np.int64)
    rows[:, 3] = _SKIPS + before(kind, 3, START_CLASS)
    return rows, both


def skip_contexts(words: Vocabulary, h: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the second word before each token, with a part of that of the word between if it is a frequent one."""
    n = len(h)
    two, parts, one = np.full(n, START), np.zeros(n, _U64), np.full(n, START)
    one[1:], two[2:] = h[:-1], h[:-2]
    if len(words.token):
        parts[2:] = np.where(at[:-2] >= 0, words.parts[at[:-2]], _U64(0))
    first = bounds[:-1]
    one[first] = START
    for k in (first, first[np.diff(bounds) > 1] + 1):
        two[k], parts[k] = START, words.start_parts
    return kernel.mix(two * _U64(5) + (one & parts))


def ngram_keys(skip: np.ndarray, both: np.ndarray, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of n-grams by skip context, class, and two words before, then by token."""
    context = np.maximum(kernel.mix(both + (kind.astype(_U64) << _U64(32))) >> _U64(64 - _CONTEXT_BITS), _U64(1))
    own = (kind - END_CLASS - 1).astype(_U64) << _SKIP_BITS
    return (skip >> _U64(44) << _U64(44)) | own | (context << _ID_BITS) | (place + 1).astype(_U64)


def exponents(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class weights of each token, their exponentials and the sums of these."""
    z = np.take(weights, rows[:, 0], axis=0)
    part = np.empty_like(z)
    for k in range(1, rows.shape[1]):
        np.take(weights, rows[:, k], axis=0, out=part, mode="clip")
        z += part
    z += weights[_BIAS]
    if len(z) and z.max() > 60:  # else all exponentials are finite as they are
        z -= z.max(axis=1, keepdims=True)
    e = np.exp(z, out=part)
    return z, e, e @ np.ones(e.shape[1], np.float32)


def log_softmax(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The natural log probability of each token's class."""
    z, _, total = exponents(weights, rows)
    return np.minimum(z[np.arange(len(target)), target] - np.log(total), 0)  # rounding can pass 0


class Trainer:
    """Adagrad with one step size for each feature, from common weights over one partition's tokens."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.copy()
        self.squares = np.full(len(weights), 1.0, np.float32)
        self.touched = np.zeros(len(weights), np.float32)

    def step(self, rows: np.ndarray, target: np.ndarray) -> None:
        _, grad, total = exponents(self.weights, rows)
        grad /= total[:, None]
        grad[np.arange(len(target)), target] -= 1
        for k in range(3):
            order = np.argsort(rows[:, k])
            own = rows[order, k]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self._move(own[first], np.add.reduceat(np.take(grad, order, axis=0), first, axis=0), np.diff(np.append(first, len(own))))
        own = rows[:, 3] - _SKIPS  # few rows: their sums are one product
        which = np.zeros((len(own), CLASSES + 1), np.float32)
        which[np.arange(len(own)), own] = 1
        n = np.bincount(own, minlength=CLASSES + 1)
        some = np.flatnonzero(n)
        self._move(_SKIPS + some, (which.T @ grad)[some], n[some])
        self._move(np.array([_BIAS]), grad.sum(axis=0, keepdims=True), np.array([len(target)]))

    def _move(self, rows: np.ndarray, grad: np.ndarray, n: np.ndarray) -> None:
        self.squares[rows] += np.einsum("ij,ij->i", grad, grad)
        grad *= (np.float32(RATE) / np.sqrt(self.squares[rows]))[:, None]
        self.weights[rows] -= grad
        self.touched[rows] += n


def _train_round(spark, texts: DataFrame, vocab, weights: np.ndarray) -> np.ndarray:
    shared = spark.sparkContext.broadcast(weights)  # ROWS x CLASSES numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, words, part = Trainer(shared.value), vocab.value, TaskContext.get().partitionId()
        for batch in batches:
            buf, offsets = kernel.utf8(batch.column(0))
            for a, b in kernel.chunks(offsets):
                h, kind, bounds = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                kind = words.classes(words.find(h), kind)
                rows, _ = contexts(h, kind, bounds)
                for k in range(0, len(h), BATCH_TOKENS):
                    trainer.step(rows[k : k + BATCH_TOKENS], kind[k : k + BATCH_TOKENS])
        moved = (trainer.weights - shared.value) * trainer.touched[:, None]
        for k in range(0, ROWS, BLOCK_ROWS):
            touched = trainer.touched[k : k + BLOCK_ROWS]
            if touched.any():
                yield _update(k, part, touched, moved[k : k + BLOCK_ROWS])

    updates = texts.mapInArrow(run, _UPDATE)
    left = texts.rdd.getNumPartitions()
    while left > 1:  # a task adds FAN_IN blocks
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        updates = updates.select("block", group.alias("group"), "part", "touched", "moved").repartition("block", "group").sortWithinPartitions("block", "group", "part").mapInArrow(_added, _UPDATE)
        left = -(-left // FAN_IN)
    weights = weights.copy()
    for r in updates.collect():  # ROWS x CLASSES numbers
        touched = np.frombuffer(bytes(r["touched"]), np.float32)
        moved = np.frombuffer(bytes(r["moved"]), np.float32).reshape(-1, CLASSES)
        weights[r["block"] : r["block"] + len(moved)] += moved / np.maximum(touched, 1)[:, None]
    return weights


_UPDATE = "block long, part long, touched binary, moved binary"


def _update(block: int, part: int, touched: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    data = [touched.astype(np.float32).tobytes(), moved.astype(np.float32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], ["block", "part", "touched", "moved"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the updates of each (block, group), which stand together."""
    at, total, weight = None, None, None
    for batch in batches:
        for block, group, touched, moved in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
            touched = np.frombuffer(touched.as_buffer(), np.float32)
            moved = np.frombuffer(moved.as_buffer(), np.float32).reshape(-1, CLASSES)
            if (block, group) != at:
                if at is not None:
                    yield _update(*at, weight, total)
                at, total, weight = (block, group), np.zeros(moved.shape), np.zeros(len(touched))
            total += moved
            weight += touched
    if at is not None:
        yield _update(*at, weight, total)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def _ngram_counts(vocab, bits: int):
    """(shard, keys, counts) of training texts; own classes and the end, which are sure of their token, are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = vocab.value, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            key = np.sort(np.concatenate(held))
            held.clear()
            size = 0
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[first], np.diff(np.append(first, len(key))).astype(np.uint32)
            for shard, a, b in _shards(key, bits):
                yield _block_row(shard, _TABLE, key[a:b], n[a:b])

        for batch in batches:
            buf, offsets = kernel.utf8(batch.column(0))
            for a, b in kernel.chunks(offsets):
                h, kind, bounds = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = words.find(h)
                kind = words.classes(at, kind)
                use = np.flatnonzero(kind > END_CLASS)
                held.append(ngram_keys(skip_contexts(words, h, at, bounds)[use], contexts(h, kind, bounds)[1][use], kind[use], at[use]))
                size += len(use)
                if size > HELD_KEYS:
                    yield from out()
        if size:
            yield from out()

    return run


_SHARD = "shard long, kind int, keys binary, about binary"


def _shards(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys; the first bits of a key are its shard."""
    if not bits:
        return [(0, 0, len(keys))]
    own = (keys >> _U64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def _block_row(shard: int, kind: int, keys: np.ndarray, about: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([kind], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([about.tobytes()], pa.binary())], ["shard", "kind", "keys", "about"])


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class InClass:
    """The weights of skips and n-grams within classes, of all tokens of some skip contexts; keys in order."""

    def __init__(self, words: Vocabulary, keys: np.ndarray, counts: np.ndarray) -> None:
        context, place = keys >> _ID_BITS, (keys & _IDS).astype(np.int64) - 1
        first = _groups(context)
        total = np.add.reduceat(counts, first)
        of_context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        skip, self.skip_n = _counted([keys & ~(_WITHIN - _IDS)], [counts])
        begin = _groups(skip >> _SKIP_BITS)
        self.skip_total = np.add.reduceat(self.skip_n, begin)
        self.skip_names = skip[begin] >> _SKIP_BITS

        # Skips first, against the shares of the class, then n-grams, against the skips.
        at = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(skip))))
        token = (skip & _IDS).astype(np.int64) - 1
        keep, start, q = self._start(self.skip_n, self.skip_total[at], token, np.zeros(len(skip)), words)
        self.skip, self.skip_n, self.skip_of, self.skip_q, self.skip_w = skip[keep], self.skip_n[keep], at[keep], q, start
        within = np.searchsorted(self.skip_names, context[first] >> (_SKIP_BITS - _ID_BITS))
        place_of_skip = np.searchsorted(self.skip, keys & ~(_WITHIN - _IDS))
        has = place_of_skip < len(self.skip)
        has[has] = self.skip[place_of_skip[has]] == keys[has] & ~(_WITHIN - _IDS)
        before = -np.log(self._skip_sums())[within[of_context]]
        before[has] += self.skip_w[place_of_skip[has]]
        keep, start, q = self._start(counts, total[of_context], place, before, words)
        self.gram, self.gram_n, self.gram_q, self.gram_w = keys[keep], counts[keep], q, start
        self.gram_skip = np.where(has, place_of_skip, len(self.skip))[keep]  # the last place is a weight of 0
        live, self.gram_of = np.unique(of_context[keep], return_inverse=True)
        self.names, self.total, self.within = context[first[live]], total[live], within[live]
        self.other_total = self.skip_total - np.bincount(self.within, self.total, len(self.skip_total))

    @staticmethod
    def _start(n: np.ndarray, total: np.ndarray, place: np.ndarray, before: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which weights are kept, where they start, and the shares of their tokens."""
        some = np.flatnonzero((n > PENALTY) & (place >= 0))
        q = words.share(place[some])
        start = np.log((n[some] - PENALTY) / total[some] / q) - before[some]
        keep = (start > 0) & (n[some] * start + (n[some] - PENALTY) * np.expm1(-start) >= LEAST_GAIN)
        return some[keep], start[keep], q[keep]

    def _skip_sums(self) -> np.ndarray:
        """The sum over its class of q and the exponential of the weight, for each skip context."""
        return 1 + np.bincount(self.skip_of, self.skip_q * np.expm1(self.skip_w), len(self.skip_total))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """These sums for skip contexts and n-gram contexts, and q times the exponential of the skip's weight for each n-gram."""
        by_skip = self.gram_q * np.exp(np.append(self.skip_w, 0)[self.gram_skip])
        alone = self._skip_sums()
        return alone, alone[self.within] + np.bincount(self.gram_of, by_skip * np.expm1(self.gram_w), len(self.names)), by_skip

    def gradients(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the weights of skips and n-grams, and the tokens expected of each."""
        alone, whole, by_skip = self.sums()
        rate = self.total / whole  # tokens of a context over its sum
        anywhere = self.other_total / alone + np.bincount(self.within, rate, len(alone))
        gram = by_skip * rate[self.gram_of]
        more = np.bincount(self.gram_skip, gram * np.expm1(self.gram_w), len(self.skip) + 1)[:-1]
        skip = self.skip_q * np.exp(self.skip_w) * anywhere[self.skip_of] + more
        gram = gram * np.exp(self.gram_w)
        return self.skip_n - PENALTY - skip, self.gram_n - PENALTY - gram, skip, gram

    def step(self) -> None:
        skip, gram, skip_tokens, gram_tokens = self.gradients()
        self.skip_w += skip / (2 * np.maximum(self.skip_n, skip_tokens))
        self.gram_w += gram / (2 * np.maximum(self.gram_n, gram_tokens))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, values and the tokens of their skip contexts.

        A value is log10 of what a token's probability in its class is multiplied by: at the n-gram's key
        for its token, at the context's (0 in the last bits), or else the skip context's (0 in the
        context's bits too), for all other tokens, times that at the skip's key for its token.
        """
        alone, whole, _ = self.sums()
        gram = self.gram_w + np.append(self.skip_w, 0)[self.gram_skip] - np.log(whole)[self.gram_of]
        some = np.unique(self.skip_of)
        some = np.union1d(some, self.within)
        keys = np.concatenate([self.gram, self.names << _ID_BITS, self.skip, self.skip_names[some] << _SKIP_BITS])
        values = np.concatenate([gram, -np.log(whole), self.skip_w, -np.log(alone)[some]]) / np.log(10)
        sizes = self.skip_total[np.concatenate([self.within[self.gram_of], self.within, self.skip_of, some])]
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32), sizes[order]


def ngram_weights(words: Vocabulary, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trained table of all tokens of some skip contexts; keys: distinct, in order."""
    model = InClass(words, keys, counts)
    for _ in range(STEPS):
        model.step()
    return model.table()


def _ngram_table(vocab, bits: int, hot_tokens: float):
    """(shard, keys, values) from the counts of each shard, for hot skip contexts also in other shards, and the list of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, current, keys, counts = vocab.value, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            key, value, size = ngram_weights(words, *_counted(keys, counts))
            keys.clear()
            counts.clear()
            yield _block_row(current, _TABLE, key, value)
            hot = np.flatnonzero(size >= hot_tokens)
            if len(hot):
                for other in sorted({(current ^ salt) & ((1 << bits) - 1) for salt in range(1, SALTS)} - {current}):
                    yield _block_row(other, _TABLE, key[hot], value[hot])
                yield _block_row(current, _HOT, np.unique(key[hot] & ~_WITHIN), np.zeros(0))

        for batch in batches:
            for shard, key, n in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if shard != current and keys:
                    yield from out()
                current = shard
                keys.append(np.frombuffer(key.as_buffer(), _U64))
                counts.append(np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64))
                if sum(map(len, keys[1:])) > 2 * max(len(keys[0]), HELD_KEYS):  # equal keys become one
                    merged = _counted(keys, counts)
                    keys[:], counts[:] = [merged[0]], [merged[1]]
        if keys:
            yield from out()

    return run


def _slots(keys: np.ndarray) -> np.ndarray:
    return (kernel.mix(keys) >> _U64(42)).astype(np.int64)


class Table:
    """A shard's keys and values, for lookups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        alone = keys & _WITHIN == 0
        self.skips, self.skip_values = keys[alone], values[alone]
        self.keys, self.values = keys[~alone], values[~alone]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[_slots(self.keys)] = True

    def _at(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are in the table, and their values."""
        maybe = np.flatnonzero(self.seen[_slots(asked)])
        at = np.minimum(np.searchsorted(self.keys, asked[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == asked[maybe]
        return maybe[hit], self.values[at[hit]]

    def find(self, asked: np.ndarray) -> np.ndarray:
        """What each n-gram's probability in its class is multiplied by, as a log10."""
        out = np.zeros(len(asked))
        if not len(self.skips):
            return out
        alone = asked & ~_WITHIN
        at = np.minimum(np.searchsorted(self.skips, alone), len(self.skips) - 1)
        known = np.flatnonzero(self.skips[at] == alone)  # others have no weight at all
        asked, alone, value = asked[known], alone[known], self.skip_values[at[known]].astype(np.float64)
        if len(self.keys):
            hit, found = self._at(asked & ~_IDS)
            value[hit] = found
            token = asked & _IDS
            hit, found = self._at(alone | token)
            value[hit] += found
            hit, found = self._at(asked)
            value[hit] = found
        out[known] = value
        return out


_DOCUMENT = "uid long, doc_id long, n_tokens long, n_known long, frequent double, own double, score double, rare array<long>"
_ASKED = f"{_SHARD}, origin long, uids binary, docs binary, {_DOCUMENT}"
_ANSWERED = f"kind int, origin long, uids binary, docs binary, sums binary, {_DOCUMENT}"
#: Kinds of rows: a shard's table, what is asked of it, hot skip contexts, a document, the documents of all that was asked at once.
_TABLE, _QUESTION, _HOT, _ROW, _ORIGIN = range(5)


def _filled(schema: list[tuple[str, pa.DataType]], n: int, **own: pa.Array) -> pa.RecordBatch:
    """n rows with nulls in the columns that are not given."""
    return pa.RecordBatch.from_arrays([own[name] if name in own else pa.nulls(n, kind) for name, kind in schema], [name for name, _ in schema])


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and origins as they are; of each shard its table comes before the questions, whose answers are sums by document."""
    schema = _arrow(_ANSWERED)
    current, parts, table = None, [], None
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds >= _ROW).any():
            rows = batch.filter(pa.array(kinds >= _ROW))
            yield _filled(schema, rows.num_rows, **{name: rows.column(name) for name, _ in schema if name != "sums"})
        for k in np.flatnonzero(kinds < _ROW):
            shard = batch.column(0)[k].as_py()
            if shard != current:
                current, parts, table = shard, [], None
            keys = np.frombuffer(batch.column(2)[k].as_buffer(), _U64)
            if kinds[k] == _TABLE:
                parts.append((keys, np.frombuffer(batch.column(3)[k].as_buffer(), np.float32)))
                continue
            if table is None and any(len(x[0]) for x in parts):
                key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                key, first = np.unique(key, return_index=True)
                table, parts = Table(key, value[first]), []
            if table is None:
                continue
            runs = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint16).astype(np.int64)
            total = np.add.reduceat(table.find(keys), np.concatenate([[0], np.cumsum(runs)[:-1]]))
            some = np.flatnonzero(total)
            if len(some):
                docs = np.cumsum(np.frombuffer(batch.column(6)[k].as_buffer(), np.uint16).astype(np.int64))[some]
                data = {"docs": docs.astype(np.uint16), "sums": total[some]}
                yield _filled(schema, 1, kind=pa.array([_QUESTION], pa.int32()), origin=batch.column(4).slice(int(k), 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in data.items()})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, ngrams) of the documents of each origin, whose uids come before its answers."""
    uids, total = None, None

    def out() -> pa.RecordBatch:
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(uids[some]), pa.array(total[some])], ["uid", "ngrams"])

    for batch in batches:
        for kind, own, docs, sums in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4), strict=True):
            if kind == _ORIGIN:
                if uids is not None:
                    yield out()
                uids = np.frombuffer(own.as_buffer(), np.int64)
                total = np.zeros(len(uids))
            else:
                total += np.bincount(np.frombuffer(docs.as_buffer(), np.uint16), np.frombuffer(sums.as_buffer()), len(total))
    if uids is not None:
        yield out()


@dataclass
class Model:
    """The vocabulary, class weights, and the n-gram table (``_SHARD``) with its hot skip contexts."""

    counts: DataFrame
    words: Vocabulary
    weights: np.ndarray
    ngrams: DataFrame
    bits: int
    hot: np.ndarray


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def train(docs: DataFrame) -> Model:
    """A model of the documents outside the held-out fold."""
    docs, spark = _plain(docs), docs.sparkSession
    training = docs.filter(labelled.fold(F.col("doc_id")) != HELD_OUT)
    counts = training.select("text").mapInArrow(_counts, "token long, kind int, n long").groupBy("token").agg(F.min("kind").alias("kind"), F.sum("n").alias("c"))
    counts = written(counts, "counts")
    words = vocabulary(counts)
    vocab = spark.sparkContext.broadcast(words)  # bounded by TOP_TOKENS
    bits = max(0, math.ceil(math.log2(max(words.n_tokens, 1) / SHARD_TOKENS)))
    grams = training.select("text").mapInArrow(_ngram_counts(vocab, bits), _SHARD).repartition("shard").sortWithinPartitions("shard").mapInArrow(_ngram_table(vocab, bits, max(2, words.n_tokens * HOT_SHARE)), _SHARD)
    grams = written(grams, "ngrams")
    hot = [np.frombuffer(bytes(r["keys"]), _U64) for r in grams.filter(F.col("kind") == _HOT).select("keys").collect()]  # at most 1 / HOT_SHARE skip contexts
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[_BIAS] = np.log(words.class_tokens + 1) - np.log(words.class_tokens.sum() + CLASSES)
    for k in range(ROUNDS):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k
        weights = _train_round(spark, training.filter(part).select("text"), vocab, weights)
    return Model(counts, words, weights, grams.filter(F.col("kind") == _TABLE), bits, np.sort(np.concatenate([np.zeros(0, _U64), *hot])))


def _dealt(uids: np.ndarray, n: int) -> pa.Array:
    """A number below 0, which is no shard, by which n rows travel together."""
    return pa.array(np.full(n, -1 - (int(uids[0]) & 0xFFFFFFFF)))


def _scored(vocab, shared, bits: int, hot: np.ndarray):
    """A row of each document with all but the n-grams' part, and blocks of the keys that are asked for it."""
    schema = _arrow(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, part = vocab.value, shared.value, TaskContext.get().partitionId()
        held: list[tuple] = []
        size = documents = flushes = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size, documents, flushes
            origin = pa.array([(part << 32) + flushes])
            key, n, uids = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.arange(len(n)), n)
            held.clear()
            size, documents, flushes = 0, 0, flushes + 1
            shard = (key >> _U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            if len(hot):
                own = key & ~_WITHIN
                busy = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
                shard[busy] = (shard[busy] ^ (flushes + part) % SALTS) & ((1 << bits) - 1)
            order = np.argsort(shard, kind="stable")
            shard, key, doc = shard[order], key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(first, np.append(first[1:], len(key)), strict=False):
                begin = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
                begin = np.union1d(begin, np.arange(0, b - a, MOST_DOCUMENTS))
                data = {"keys": key[a:b], "about": np.diff(np.append(begin, b - a)).astype(np.uint16), "docs": np.diff(doc[a + begin], prepend=0).astype(np.uint16)}
                yield _filled(schema, 1, shard=pa.array([int(shard[a])]), kind=pa.array([_QUESTION], pa.int32()), origin=origin, **{n: pa.array([x.tobytes()], pa.binary()) for n, x in data.items()})
            yield _filled(schema, 1, shard=_dealt(uids, 1), kind=pa.array([_ORIGIN], pa.int32()), origin=origin, uids=pa.array([uids.tobytes()], pa.binary()))

        for batch in batches:
            # Rows that repeat doc_id and text in a partition share a uid, whatever their order.
            uids = kernel.mix(batch.column(2).to_numpy().view(_U64) + _U64(part)).view(np.int64)
            buf, offsets = kernel.utf8(batch.column(1))
            for a, b in ((c, min(c + MOST_DOCUMENTS, b)) for a, b in kernel.chunks(offsets) for c in range(a, b, MOST_DOCUMENTS)):
                if documents + b - a > MOST_DOCUMENTS:
                    yield from out()
                h, kind, bounds = tokenize(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = words.find(h)
                kind = words.classes(at, kind)
                rows, both = contexts(h, kind, bounds)
                logs = np.empty(len(h))
                for k in range(0, len(h), BATCH_TOKENS):
                    logs[k : k + BATCH_TOKENS] = log_softmax(weights, rows[k : k + BATCH_TOKENS], kind[k : k + BATCH_TOKENS])
                logs /= np.log(10)
                logs -= words.class_place[kind]
                frequent = np.where(at >= 0, words.log_count[at], 0.0) if len(words.token) else np.zeros(len(h))
                own = np.where(kind <= END_CLASS, frequent, 0.0)
                first = bounds[:-1]
                sums = [np.add.reduceat(x, first) for x in ((at >= 0).astype(np.int64), frequent, own, logs)]
                rare = np.flatnonzero(at < 0)
                rare_at = np.searchsorted(rare, bounds).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rare_at), pa.array(kernel.signed(h[rare])))
                n = b - a
                about = dict(zip(("n_known", "frequent", "own", "score"), map(pa.array, sums), strict=True))
                yield _filled(schema, n, shard=_dealt(uids[a:b], n), kind=pa.array(np.full(n, _ROW, np.int32)), uid=pa.array(uids[a:b]), doc_id=batch.column(0).slice(a, n), n_tokens=pa.array(np.diff(bounds)), rare=rare, **about)
                use = np.flatnonzero(kind > END_CLASS)
                held.append((ngram_keys(skip_contexts(words, h, at, bounds)[use], both[use], kind[use], at[use]), np.diff(np.searchsorted(use, bounds)), uids[a:b]))
                size, documents = size + len(use), documents + n
                if size > HELD_KEYS:
                    yield from out()
        if documents:
            yield from out()

    return run


def score(docs: DataFrame) -> DataFrame:
    """Model and unigram scores of every document (doc_id, text), in log10 probabilities."""
    return scored(docs, train(docs))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    docs, spark, words = _plain(docs), docs.sparkSession, model.words
    vocab, weights = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(model.weights)
    asked = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(_scored(vocab, weights, model.bits, model.hot), _ASKED)
    both = asked.unionByName(model.ngrams, allowMissingColumns=True)
    parts = written(both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_answered, _ANSWERED), "parts")
    documents = parts.filter(F.col("kind") == _ROW).select([x.split()[0] for x in _DOCUMENT.split(", ")])
    once = documents.groupBy("uid").agg(F.count(F.lit(1)).alias("repeats"))  # what follows has all repeats together
    answers = parts.filter(F.col("kind") != _ROW).select("origin", "kind", "uids", "docs", "sums")
    grams = answers.repartition("origin").sortWithinPartitions("origin", F.desc("kind")).mapInArrow(_summed, "uid long, ngrams double").groupBy("uid").agg(F.sum("ngrams").alias("ngrams"))
    rare = documents.select("uid", F.explode("rare").alias("token")).groupBy("uid", "token").agg(F.count(F.lit(1)).alias("times"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(model.counts.select("token", "c"), "token", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    rare_log = F.coalesce(F.col("rare_log") / F.col("repeats"), F.lit(0.0))
    rare_known = F.coalesce(F.col("rare_known") / F.col("repeats"), F.lit(0.0)).cast("long")
    return documents.drop("rare").join(once.join(grams, "uid", "left").join(rare, "uid", "left"), "uid").select(
        "doc_id",
        (labelled.fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + rare_known).alias("n_known"),
        F.lit(words.n_tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + rare_log - F.col("n_tokens") * words.log_place).alias("base_score"),
        (F.col("score") + F.col("frequent") - F.col("own") + rare_log + F.coalesce(F.col("ngrams") / F.col("repeats"), F.lit(0.0))).alias("score"),
    )
