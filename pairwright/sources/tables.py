"""Raw CSV tables as text columns with a row index, and finished tables back as CSV.

A table keeps its header apart from its data: columns are c0, c1, ... in file order, so that
names may repeat.  All cells are text; blank ones are null.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import number_text
from . import csv_records

INDEX = "row_index"


@dataclass
class RawTable:
    headers: list[str]
    rows: DataFrame

    @property
    def columns(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.headers))]

    def named(self) -> DataFrame:
        """The rows under their headers; repeated or blank headers get a number."""
        names: list[str] = []
        for k, h in enumerate(self.headers):
            name = h.strip() or f"column {k + 1}"
            names.append(name if name not in names else f"{name} ({k + 1})")
        return self.rows.select(INDEX, *(F.col(c).alias(n) for c, n in zip(self.columns, names, strict=True)))


def with_row_index(df: DataFrame, name: str = INDEX) -> DataFrame:
    """Rows numbered from 0 without gaps in the order of their partitions, by one count a partition."""
    marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    from pyspark.sql import Window

    counts = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = counts.select("__part", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return marked.join(F.broadcast(starts), "__part").select((F.col("start") + F.col("__place") - F.col("first")).alias(name), *df.columns)


def load_csv(spark: SparkSession, path: str, drop_blank_rows: bool = False) -> RawTable:
    """One CSV file with a header row: quotes doubled, UTF-8 with or without a mark, any line ends, blank lines passed over.

    The file is read in as many tasks as it has splits (``csv_records``).  An empty file and a row of another width
    than the header's are errors, told with the number of the record.  Rows are indexed in file order without gaps;
    ``drop_blank_rows`` passes over rows with nothing but white space and leaves their numbers out.
    """
    found, splits = csv_records.table(spark, path)
    first = found.filter("row = 0").first() if splits else None
    if first is None:
        raise ValueError(f"{path}: file is empty")
    headers = list(first["cells"])
    headers[0] = headers[0].removeprefix("\ufeff")
    ragged = found.filter(F.size("cells") != len(headers)).agg(F.min(F.struct("record", F.size("cells").alias("n"))).alias("x")).first()["x"]
    if ragged is not None:
        raise ValueError(f"{path}: line {ragged['record'] + 1} has {ragged['n']} cells, the header has {len(headers)}")
    cell = lambda k: F.nullif(F.get("cells", F.lit(k)), F.lit(""))
    rows = found.filter("row > 0").select((F.col("row") - 1).alias(INDEX), *(cell(k).alias(f"c{k}") for k in range(len(headers))))
    if drop_blank_rows:
        filled = F.lit(False)
        for c in rows.columns[1:]:
            filled = filled | (F.trim(F.coalesce(c, F.lit(""))) != "")
        rows = rows.filter(filled)
    return RawTable(headers, rows)


def parse_csv_text(spark: SparkSession, text: str, label: str) -> RawTable:
    """A table given as text, such as one that a user has pasted; empty text gives no headers and no rows."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline="")) if r]
    headers = rows[0] if rows else []
    for k, row in enumerate(rows):
        if len(row) != len(headers):
            raise ValueError(f"{label}: line {k + 1} has {len(row)} cells, the header has {len(headers)}")
    schema = ", ".join([f"{INDEX} long", *(f"c{k} string" for k in range(len(headers)))])
    data = [(k, *(c or None for c in row)) for k, row in enumerate(rows[1:])]
    return RawTable(headers, spark.createDataFrame(data, schema))


def write_csv(df: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    """A folder of CSV files with a header, UTF-8, blanks for nulls, in as many parts as the table has partitions.

    Doubles are written as Python writes them, lists joined by ``;``.
    """
    flat = df.drop(*drop)
    flat = flat.select(*(number_text(F.col(f"`{c}`")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in flat.dtypes))
    for field in flat.schema:
        if field.dataType.typeName() == "array":
            flat = flat.withColumn(field.name, F.array_join(field.name, ";"))
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
