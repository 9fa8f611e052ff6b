"""CSV files in parallel: splits of one file are parsed from states that a scan over all splits has found.

Spark reads the lines of a file in splits.  Whether a line begins within quotes depends on all before it, so
a first pass gives each split's answer for both cases: how it leaves quotes, and how many records begin in it.
A prefix scan over the splits, a row each, then tells where each one stands, and every task parses
its own lines.  Only a record that crosses a border is put together by a shuffle.

Records are those of Python's ``csv`` module: quotes doubled within quotes, quotes inside an unquoted cell are
text, and line ends are ``\\n``, ``\\r\\n`` or ``\\r``.  (A file with ``\\r`` alone has but one line for Spark, and one task.)
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "record long, row long, cells array<string>, piece long, text string"


@dataclass(frozen=True)
class Split:
    """Where a split stands: within quotes or not, and the records and filled records that have begun before it."""

    within: bool
    records: int
    rows: int


def scan(line: str, within: bool) -> tuple[bool, int, int]:
    """(within quotes at the end, records that end in the line, those of them with a cell); the line has no ``\\n``.

    The end of the line ends a record too, unless it lies within quotes.
    """
    at, size, records, rows = 0, len(line), 0, 0
    filled = within  # what has begun before has something in it
    while True:
        if within:
            while True:
                quote = line.find('"', at)
                if quote < 0:
                    return True, records, rows
                if line.startswith('"', quote + 1):
                    at = quote + 2
                    continue
                at, within = quote + 1, False
                break
        elif at < size and line[at] == '"':
            at, within, filled = at + 1, True, True
            continue
        # What is left of the cell is plain text up to a comma or a line end.
        comma, turn = line.find(",", at), line.find("\r", at)
        if turn >= 0 and (comma < 0 or turn < comma):
            filled = filled or turn > at
            if turn + 1 == size:  # the \r of \r\n
                return False, records + 1, rows + filled
            records, rows = records + 1, rows + filled
            at, filled = turn + 1, False
        elif comma >= 0:
            at, filled = comma + 1, True
        else:
            return False, records + 1, rows + (filled or at < size)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(split, value): the lines of a file in order within each split; a split is named by the byte at which it begins."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """(split, some of its lines); a task reads its splits one after the other."""
    for batch in batches:
        splits = batch.column(0).to_numpy()
        values = batch.column(1).to_pylist()
        begin = 0
        while begin < len(values):
            end = begin + 1
            if splits[begin] == splits[-1]:
                end = len(values)
            else:
                while end < len(values) and splits[end] == splits[begin]:
                    end += 1
            yield int(splits[begin]), values[begin:end]
            begin = end


def states(lines: DataFrame) -> tuple[dict[int, Split], bool]:
    """Where each split stands, and whether the last one ends within quotes; a few numbers a split come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[list]] = {}
        for split, values in _by_split(batches):
            state = found.setdefault(split, [[False, 0, 0], [True, 0, 0]])
            for line in values:
                plain = '"' not in line and "\r" not in line[:-1]
                for s in state:
                    if plain and s[0]:
                        continue
                    ends, records, rows = (False, 1, line not in ("", "\r")) if plain else scan(line, s[0])
                    s[:] = [ends, s[1] + records, s[2] + rows]
        rows = [(split, within, *state[within]) for split, state in found.items() for within in (False, True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))], ["split", "within", "ends", "records", "rows"])

    found = {(r["split"], r["within"]): r for r in lines.mapInArrow(run, "split long, within boolean, ends boolean, records long, rows long").collect()}
    out, within, records, rows = {}, False, 0, 0
    for split in sorted({s for s, _ in found}):
        out[split] = Split(within, records, rows)
        r = found[split, within]
        within, records, rows = r["ends"], records + r["records"], rows + r["rows"]
    return out, within


def _parsed(text: Iterator[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(text)


def records(lines: DataFrame, stand: dict[int, Split]) -> DataFrame:
    """(record, row, cells, piece, text) of all filled records: its number among all and among the filled ones, and its cells.

    A record that crosses the end of a split comes as pieces of text instead, numbered by their split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["record", "row", "cells", "piece", "text"])

        current, at, held, leading = None, None, [], False

        def flush(rows: list[tuple]) -> None:
            """What is open when a split ends is a piece of a record that goes on."""
            if current is not None and held:
                rows.append((at[0] - leading, at[1] - leading, None, current, "\n".join(held) + "\n"))

        for split, values in _by_split(batches):
            rows: list[tuple] = []
            if split != current:
                flush(rows)
                s = stand[split]
                current, at, held, leading, within = split, [s.records, s.rows], [], s.within, s.within
                at[0] += s.within
                at[1] += s.within
            whole: list[str] = []
            for line in values:
                ends, _, _ = (within, 0, 0) if '"' not in line else scan(line, within)
                held.append(line)
                within = ends
                if within:
                    continue
                if leading:  # the end of a record that began in an earlier split, and whatever ``\\r`` has put behind it
                    cut = _after_first(held)
                    rows.append((at[0] - 1, at[1] - 1, None, current, "\n".join(held)[:cut]))
                    rest = "\n".join(held)[cut:]
                    held, leading = [], False
                    if rest:
                        whole.append(rest + "\n")
                    continue
                whole.append("\n".join(held) + "\n")
                held = []
            for cells in _parsed(io.StringIO("".join(whole), newline="")):
                if cells:
                    rows.append((at[0], at[1], cells, None, None))
                    at[1] += 1
                at[0] += 1
            yield out(rows)
        rows = []
        flush(rows)
        yield out(rows)

    return lines.mapInArrow(run, _ROWS)


def _after_first(held: list[str]) -> int:
    """The length of the first record in lines that begin within quotes, up to a ``\\r`` that ends it."""
    text, at, within = "\n".join(held), 0, True
    while True:
        if within:
            quote = text.find('"', at)
            if text.startswith('"', quote + 1):
                at = quote + 2
                continue
            at, within = quote + 1, False
        comma, turn = text.find(",", at), text.find("\r", at)
        if turn >= 0 and (comma < 0 or turn < comma):
            return turn + 1
        if comma < 0:
            return len(text)
        at = comma + 1
        within = text.startswith('"', at)
        at += within


def table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(record, row, cells) of the filled records of one file, and how many there are."""
    lines = _lines(spark, path)
    stand, unclosed = states(lines)
    found = records(lines, stand)
    whole = found.filter("cells is not null").select("record", "row", "cells")
    if unclosed or any(s.within for s in stand.values()):

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [next(_parsed(io.StringIO(text, newline=""))) for text in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["record", "row", "cells"])

        pieces = found.filter("piece is not null").groupBy("record", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
        whole = whole.unionByName(pieces.mapInArrow(join, "record long, row long, cells array<string>"))
    return whole, len(stand)
