"""Token counts of documents in flat token files without an index.

A file is a run of token ids in which an end-of-document id closes each document; it comes
as blocks (file, block, data) that take no notice of documents.  Each block is searched for
the end id at once with numpy.  What a document has in earlier blocks comes from a prefix scan
over block summaries (tokens, ends, place of the last end): first within groups of
``SCAN_GROUP`` blocks, then over the groups, so no task needs all blocks of a file.

Nulls: blocks with null data count as empty; a null text is written as an empty document
(its end id alone); a null doc_id stays null.  Repeated documents are counted each; an empty
table gives no rows; texts are read whole, whatever their length; tokens after a file's last end id give one row that is not ``ended``.
Columns with other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .store import written
from .tokens import vocabulary_path, word_tokens

BLOCK_TOKENS = 1 << 17
SCAN_GROUP = 1024
END_ID = 49407


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenize documents into flat files in the shared folder, a file for each input partition.

    Returns the blocks (file, block, data: little-endian 16-bit ids) and, apart from them, the
    order of documents (file, ordinal, doc_id), which the scan itself does not use.
    """
    path = tokenizer or vocabulary_path("word_bpe_49k.json")
    if not 0 <= end_id < 1 << 16:
        raise ValueError("token files hold 16-bit ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path, specials_as_text=True)
        file, block, ordinal = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        size = 0

        def row(kind: str, at: int, data: bytes | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([file], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["kind", "file", "at", "data", "ids"]
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            if ids:
                yield row("order", ordinal, None, ids)
                ordinal += len(ids)
            buf, offsets = kernel.utf8(batch.column(1))
            for a, b in kernel.chunks(offsets):
                tokens, at = encoder.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.insert(tokens.astype("<u2"), at[1:], end_id)
                held.append(flat)
                size += len(flat)
                if size >= block_tokens:
                    stream = np.concatenate(held)
                    for k in range(0, size - block_tokens + 1, block_tokens):
                        yield row("tokens", block, stream[k : k + block_tokens].tobytes(), None)
                        block += 1
                    held = [stream[size - size % block_tokens :].copy()]
                    size = len(held[0])
        if size:
            yield row("tokens", block, np.concatenate(held).tobytes(), None)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = plain.mapInArrow(run, "kind string, file long, at long, data binary, ids array<long>")
    stored = written(rows, "token-files", partition_by="kind")
    blocks = stored.filter("kind = 'tokens'").select("file", F.col("at").alias("block"), "data")
    order = stored.filter("kind = 'order'").select("file", "at", F.posexplode("ids").alias("place", "doc_id"))
    return blocks, order.select("file", (F.col("at") + F.col("place")).alias("ordinal"), "doc_id")


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of raw files of little-endian 16-bit ids; a file is read by one task and must be below 2 GB."""
    width = 2 * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(data.as_buffer())
                for k in range(0, len(view), width):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k // width], pa.int64()), pa.array([bytes(view[k : k + width])], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def find_ends(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, block, n, ends): the number of ids of each block and the places of the end id."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u2") for x in batch.column(2)]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    return blocks.select("file", F.col("block").cast("long").alias("block"), "data").mapInArrow(run, f"file {kind}, block long, n long, ends array<long>")


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document; the end id is not counted."""
    found = written(find_ends(blocks, end_id), "ends")
    group = F.floor(F.col("block") / SCAN_GROUP).cast("long")
    summary = found.select("file", "block", group.alias("group"), "n", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    earlier_groups = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, window: Window) -> F.Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    groups = summary.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"))
    groups = groups.select("file", "group", before("n", earlier_groups).alias("group_start"), before("n_ends", earlier_groups).alias("group_ends"))
    placed = summary.join(groups, ["file", "group"]).select(
        "file", "block", "group", "n",
        (F.col("group_start") + before("n", earlier_blocks)).alias("start"),
        (F.col("group_ends") + before("n_ends", earlier_blocks)).alias("first_ordinal"),
        "last",
    )
    placed = placed.withColumn("open_from", F.col("start") + F.col("last") + 1)  # null where a block has no end
    latest = placed.groupBy("file", "group").agg(F.max("open_from").alias("latest"))
    latest = latest.select("file", "group", F.max("latest").over(earlier_groups).alias("group_open"))
    carried = placed.join(latest, ["file", "group"]).select(
        "file", "block", "start", "first_ordinal", "n",
        F.coalesce(F.max("open_from").over(earlier_blocks), "group_open", F.lit(0)).alias("open_from"),
    )
    ends = found.select("file", "block", F.posexplode("ends").alias("k", "end"), F.col("ends"))
    ends = ends.select("file", "block", "k", "end", F.when(F.col("k") > 0, F.try_element_at("ends", F.greatest("k", F.lit(1)))).alias("previous"))
    closed = ends.join(carried, ["file", "block"]).select(
        "file",
        (F.col("first_ordinal") + F.col("k")).alias("ordinal"),
        F.coalesce(F.col("start") + F.col("previous") + 1, "open_from").alias("begin"),
        (F.col("start") + F.col("end")).alias("end"),
        F.lit(True).alias("ended"),
    )
    whole = summary.groupBy("file").agg(F.sum("n").alias("end"), F.sum("n_ends").alias("ordinal"))
    last = placed.groupBy("file").agg(F.coalesce(F.max("open_from"), F.lit(0)).alias("begin"))
    unfinished = whole.join(last, "file").filter("begin < end").select("file", "ordinal", "begin", "end", F.lit(False).alias("ended"))
    return closed.unionByName(unfinished).select("file", "ordinal", F.col("begin").alias("start"), (F.col("end") - F.col("begin")).alias("n_tokens"), "ended")


def document_counts(docs: DataFrame) -> DataFrame:
    """Tokenize documents into flat files, then count each document's tokens from the files alone."""
    blocks, order = write_token_files(docs)
    return count_tokens(blocks).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
