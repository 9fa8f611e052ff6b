"""Similarity join of documents on word n-grams, by MinHash banding and exact verification.

Words are the runs of letters, digits and non-ASCII characters of the lower-cased text; a text
has the set of its runs of five words (fewer words: one run of all; no words: the text
itself).  Documents with the same set are one class of copies and take part once.  Bands and
rows come from the target recall at the threshold; classes that share a band meet, and are
linked if the Jaccard similarity of their full sets is ``THRESHOLD`` or more.

Result, one row for each row of documents: doc_id, class_id (the least doc_id that links
lead to), n_links (other documents linked to it, copies among them), n_copies (documents with
the same set, itself among them) and n_similar (different sets linked to its own).

Nulls: a null text counts as empty, and all empty texts are copies of each other.  Rows with
a null doc_id take part as copies of their class, with a null doc_id in the result; a class
of such rows alone has a null class_id and no links beyond it.  Repeated rows count as copies
each.  Texts are read whole, whatever their length.  Ties of similarity at the threshold are links.
An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, neighbours
from .components import connected_components, join_spread
from .store import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
ROWS = 5
BANDS = neighbours.bands_for(THRESHOLD, RECALL, ROWS)


def word_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, hashes, bounds): the sets of rows a to b, each sorted; ``bounds`` has b - a + 1 places."""
    texts = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    buf, offsets = kernel.utf8(texts)
    for a, b in kernel.chunks(offsets):
        part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, rows = kernel.spans(part, at, kernel.WORDISH)
        h, own = kernel.shingles(kernel.hash_spans(part, start, end), rows, WORDS)
        bare = np.setdiff1d(np.arange(b - a), own)
        if len(bare):
            h = np.concatenate([h, ~kernel.hash_spans(part, at[bare], at[bare + 1])])
            own = np.concatenate([own, bare])
        yield a, b, *neighbours.sorted_sets(h, own, b - a)


def _identity(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; equal sets have equal names."""
    low = np.bitwise_xor.reduceat(kernel.mix(h), bounds[:-1])
    high = np.add.reduceat(kernel.mix(h ^ np.uint64(0x5BD1E995)), bounds[:-1])
    return kernel.mix(low ^ kernel.mix(high + np.diff(bounds).astype(np.uint64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = kernel.MinHash(BANDS, ROWS)
    names = ["doc_id", "node", "size", *(f"k{b}" for b in range(BANDS))]
    for batch in batches:
        for a, b, h, bounds in word_sets(batch.column(1)):
            keys = neighbours.band_keys(minhash.keys(h, bounds[:-1]))
            columns = [kernel.signed(_identity(h, bounds)), np.diff(bounds), *(keys[:, k].copy() for k in range(BANDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in columns)], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, h, bounds in word_sets(batch.column(0)):
            sets = pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in range(b - a)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(_identity(h, bounds))), sets], ["node", "content"])


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes and links of documents (doc_id, text); see the module for the columns."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    band = [f"k{b}" for b in range(BANDS)]
    kinds = ", ".join(f"{c} long" for c in ["doc_id", "node", "size", *band])
    signed = written(docs.mapInArrow(_signatures, kinds), "signatures")
    classes = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in ["size", *band]))  # copies have the same keys
    classes = written(classes.select("node", "least", "copies", "size", F.array(*band).alias("keys")), "classes")
    nodes = classes.filter("least is not null")
    members = written(neighbours.memberships(nodes, threshold), "members")

    described = members.join(nodes.select("node", "copies", "keys", "size"), "node")
    wanted = members.select("node").distinct().join(nodes.select("node", "least"), "node").select("least").distinct()
    sets = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"] == wanted["least"]).select("text").mapInArrow(_sets, "node long, content binary")
    links = written(neighbours.verified(described.join(sets, "node"), threshold), "links")

    roots = connected_components(links.select(F.col("node").alias("a"), F.col("reaches").alias("b")))
    totals = links.groupBy("node").agg(F.sum("texts").alias("n_similar"), F.sum("documents").alias("linked"))
    joined = roots.join(classes.select("node", "least"), "node")
    least = written(joined.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")), "class-ids")
    class_ids = join_spread(roots, least, "root", "n").select("node", "class_id")
    known = classes.select("node", "least", "copies").join(totals, "node", "left").join(class_ids, "node", "left")
    known = known.select(
        "node", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.col("copies").alias("n_copies"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"),
    )
    known = written(known, "known")
    return join_spread(signed.select("doc_id", "node"), known, "node", "n_copies").select("doc_id", "class_id", "n_links", "n_copies", "n_similar")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay if of each class only its least doc_id does, with all their columns.

    Of rows that repeat both doc_id and text one stays; rows with a null doc_id stay.
    """
    chosen = join(docs, threshold).filter("doc_id = class_id").groupBy(F.col("doc_id").alias("chosen_id")).agg(F.count(F.lit(1)).alias("n"))
    chosen = written(chosen, "chosen")
    key = docs["doc_id"].cast("long")
    once, more = chosen.filter("n = 1").hint("shuffle_hash"), chosen.filter("n > 1")
    kept = docs.join(once, key == once["chosen_id"], "left_semi")
    if more.limit(1).count():
        repeated = docs.join(more.hint("shuffle_hash"), key == more["chosen_id"], "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.filter(key.isNull()))
