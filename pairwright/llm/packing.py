"""Packing token sequences: online sum-of-squares placement, level by level.

Each Spark partition of the input is packed on its own in one pass, so nothing is
shuffled, a lost task is packed again alone, and the work grows with the input.  A
document's whole windows go out at once; its remainder is placed into the fill level
that least raises the sum of squared counts of partly filled windows; of levels that raise it
alike the fullest is taken, and of the windows of one level the one that came to it last.  All partly
filled windows stay open until they close exactly; a partition holds their ids, and no other.
When it ends, the fullest of them are filled with pieces of the emptiest, and the last is cut at
powers of two, where no padding is needed.  Their number grows far more slowly than a partition, so larger
partitions (``spark.sql.files.maxPartitionBytes``) leave a smaller share to that end.

Nulls: a null text counts as empty (its one id is the end id); a null doc_id stays
null.  Texts are read whole, whatever their length.  Repeated rows are packed as often as they
come.  An empty table gives no rows.  Columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernel
from .tokens import vocabulary_path, word_tokens

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Sequences that one partition can number.
PARTITION_BITS = 38

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class LevelPacker:
    """Windows by fill level.  ``count[g]`` windows hold g tokens; ``open[g]`` are they."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.count = np.zeros(capacity + 1)
        # A window filled to the end is no longer counted: 2 * count + 1 is 0 there.
        self.count[capacity] = -0.5
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += 1

    def level(self, size: int) -> int:
        """The fill level whose choice raises the sum of squared counts least; ties: the fullest; 0 opens a window."""
        count, most = self.count, self.capacity - size
        rise = 2 * count[size : size + most + 1] + 1
        rise[1:] += np.where(count[1 : most + 1] > 0, 1 - 2 * count[1 : most + 1], np.inf)
        return most - int(np.argmin(rise[::-1]))

    def place(self, piece: Piece) -> None:
        self.put(piece, self.level(len(piece.ids)))

    def put(self, piece: Piece, g: int) -> None:
        """Add a piece to a window of level g, or to a new one if that is 0."""
        filled = g + len(piece.ids)
        window = self.open[g].pop() if g else []
        self.count[g] -= g > 0
        self.n_open -= g > 0
        window.append(piece)
        if filled == self.capacity:
            self.emit(window)
        else:
            self.open.setdefault(filled, []).append(window)
            self.count[filled] += 1
            self.n_open += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        for start in range(0, n - c + 1, c):
            self.emit([Piece(doc_id, start, ids[start : start + c], n)])
        if n % c:
            self.place(Piece(doc_id, n - n % c, ids[n - n % c :].copy(), n))

    def finish(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest; cut the last at powers of two."""
        windows = [w for g in sorted(self.open, reverse=True) for w in self.open[g]]
        self.open, self.n_open, self.count[: self.capacity] = {}, 0, 0
        while windows:
            window = windows.pop(0)
            gap = self.capacity - sum(len(p.ids) for p in window)
            while gap and windows:
                piece = windows[-1].pop()
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    windows[-1].append(rest)
                window.append(piece)
                gap -= len(piece.ids)
                if not windows[-1]:
                    windows.pop()
            if gap:
                self.emit_powers(window, self.capacity - gap)
            else:
                self.emit(window)

    def emit_powers(self, pieces: list[Piece], total: int) -> None:
        """Sequences of the sizes that make up ``total`` in binary, the largest first."""
        waiting = pieces[::-1]
        for bit in reversed(range(total.bit_length())):
            need, own = total & 1 << bit, []
            while need:
                piece = waiting.pop()
                if len(piece.ids) > need:
                    piece, rest = piece.cut(need)
                    waiting.append(rest)
                own.append(piece)
                need -= len(piece.ids)
            if own:
                self.emit(own)

    def batch(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A row for each piece of a document: where it begins in the document, its length, the
    CRC-32 of its ids, and its sequence and place there.
    """
    path = tokenizer or vocabulary_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(path)
        packer = LevelPacker(capacity, TaskContext.get().partitionId() << PARTITION_BITS)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            buf, offsets = kernel.utf8(batch.column(1))
            for a, b in kernel.chunks(offsets):
                ids, at = encoder.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    packer.add(doc_ids[a + k], np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
                if len(packer.rows) > 20_000:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
