"""Labelled rows for the supervised operators: folds, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds (null id: null)."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], held_out: int = 0) -> DataFrame:
    """(label int, text) of at most ``per_class[v]`` labelled documents of each class v, one of each id.

    Of documents that share an id the least text is taken.  Ids are taken in the order of a hash of their id, never from the fold ``held_out``.
    The ids are bounded by ``per_class``, so they are broadcast to the scan of the texts.
    Labels without an id or a value and documents without a text are passed over.
    """
    usable = labels.select(labels["doc_id"].cast("long").alias("sample_id"), labels[label].cast("int").alias("label"))
    usable = usable.filter(F.col("sample_id").isNotNull() & (fold(F.col("sample_id")) != held_out))
    parts = [usable.filter(F.col("label") == v).dropDuplicates(["sample_id"]).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for v, n in per_class.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    texts = docs.select(docs["doc_id"].cast("long").alias("sample_id"), docs["text"].cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "sample_id").groupBy("sample_id", "label").agg(F.min("text").alias("text")).select("label", "text")
