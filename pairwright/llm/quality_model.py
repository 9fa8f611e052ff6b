"""Quality classifier: averaged hashed word and character n-gram vectors, softmax output.

A document's vector is the mean of the learned vectors of its words and of the character
n-grams within them (a white space on either side stands for the border of a word) and of
its pairs of one word twice; a softmax layer on it gives the class.  Both are trained by numpy stochastic gradient descent
on a bounded sample of labelled rows.  As the output is linear in the mean, scoring needs one
number a feature, the difference of the two classes' outputs, so whole texts are scored with
one table look-up an n-gram.

Nulls: a null text counts as empty and gets the model's bias; a null doc_id stays null, and
its held_out is null.  Repeated rows each get their row; an empty table gives none; without
any labelled row every score is 0.5.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, labelled

#: At most so many labelled rows of each class are used to fit.
SAMPLE_ROWS = {0: 1200, 1: 1800}
BUCKETS = 1 << 17
DIMENSIONS = 10
EPOCHS = 6
GRAMS = (3, 5)
RATE = 0.5
THRESHOLD = 0.3

_MUL = (kernel.mix(np.arange(11, 20, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the rows, with the row of each, in no set order."""
    start, end, rows = kernel.spans(buf, offsets, kernel.NOT_SPACE)
    word = (kernel.hash_spans(buf, start, end) >> np.uint64(20)).astype(np.uint32) % np.uint32(BUCKETS)
    found, own = [word], [rows.astype(np.int32)]
    twin = np.flatnonzero((word[1:] == word[:-1]) & (rows[1:] == rows[:-1])) + 1
    found.append(np.zeros(len(twin), np.uint32))  # all pairs of one word twice share a bucket: few such pairs come again
    own.append(rows[twin].astype(np.int32))
    text = buf.tobytes().decode("utf-8", "replace")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    head = np.cumsum(np.concatenate([[0], (buf & 0xC0) != 0x80]))
    if len(chars) != head[-1]:  # bytes that are no UTF-8: take them one by one
        chars, at = buf.astype(np.uint32), offsets
    else:
        at = head[offsets]
    space = (chars == 0x20) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint32(0x20), chars)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    spaces = np.concatenate([[0], np.cumsum(space)])
    for n in GRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = chars[:m] * _MUL[0] + np.uint32(n)
        for j in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _MUL[j] + chars[j : m + j]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inner = (spaces[n - 1 : n - 1 + m] - spaces[1 : m + 1] == 0) & (doc[:m] == doc[n - 1 :])
        found.append((h % np.uint32(BUCKETS))[inner])
        own.append(doc[:m][inner])
    return np.concatenate(found), np.concatenate(own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text as distinct buckets and their share."""
    for batch in batches:
        label = batch.column(0).to_pylist()
        buf, offsets = kernel.utf8(batch.column(1))
        for k in range(len(label)):
            bucket, _ = features(buf[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
            ids, count = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label[k]], pa.int32()), pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([count.astype("<u4").tobytes()], pa.binary())], ["label", "ids", "counts"]
            )


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A number for each bucket and a bias: the log-odds of label 1 are bias plus their mean."""
    rows = labelled.sample(docs, labels, "quality", SAMPLE_ROWS).mapInArrow(_counted, "label int, ids binary, counts binary").collect()
    data = sorted(((r["label"], bytes(r["ids"]), bytes(r["counts"])) for r in rows), key=lambda x: (x[1], x[2], x[0]))
    if len({x[0] for x in data}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS + 1), np.float32)
    examples = []
    for label, ids, counts in data:
        ids, share = np.frombuffer(ids, "<u4"), np.frombuffer(counts, "<u4").astype(np.float32)
        if len(ids):
            examples.append((label, ids, share / share.sum()))
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            label, ids, share = examples[k]
            hidden = np.append(share @ vectors[ids], np.float32(1))
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            rate = np.float32(RATE * (1 - step / steps))
            back = out[:, :-1].T @ p
            out -= rate * np.outer(p, hidden)
            vectors[ids] -= (rate * DIMENSIONS * np.sqrt(share))[:, None] * back  # steps by the root of a share, so that rare features move too
            step += 1
    by_bucket = vectors @ (out[1, :-1] - out[0, :-1])
    return by_bucket.astype(np.float32), float(out[1, -1] - out[0, -1])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score: the probability of label 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            buf, offsets = kernel.utf8(batch.column(1))
            scores = [np.zeros(0)]
            for a, b in kernel.chunks(offsets):
                bucket, own = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total, n = np.bincount(own, weight[bucket], b - a), np.bincount(own, minlength=b - a)
                scores.append(1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, *train(docs, labels))
    held_out = labelled.fold(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
