"""Cells of raw tables as numbers: currency signs and thousands commas go, missing tokens are null."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that count as missing, in lower case.
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "-", ".", "nan", "#n/a")

#: A decimal number as text; hexadecimal, suffixes, underscores, inf and nan are none.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _bare(cell: Column) -> Column:
    """The cell without commas, dollar signs and white space around it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), "[,$]", ""), r"^[\s ]+|[\s ]+$", "")


def is_missing(cell: Column) -> Column:
    return F.lower(_bare(cell)).isin(*MISSING_TOKENS)


def _parsed(cell: Column) -> Column:
    bare = _bare(cell)
    value = F.when(bare.rlike(NUMBER), bare).try_cast("double")
    return F.when(F.abs(value) != float("inf"), value)


def clean_value(cell: Column) -> Column:
    """The number in a cell; null where it is missing or no finite number."""
    return F.when(~is_missing(cell), _parsed(cell))


def is_invalid(cell: Column) -> Column:
    """Neither missing nor a finite number."""
    return ~is_missing(cell) & _parsed(cell).isNull()


def number_or_null(value: Column) -> Column:
    """A numeric column as a feature: NaN and infinities are missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def missing_count(features: list[Column]) -> Column:
    """How many of the features are null."""
    return reduce(add, (f.isNull().cast("int") for f in features), F.lit(0))


def numeric_prefix(cell: Column) -> Column:
    """The number that a non-missing cell begins with, as the column statistics read it (``12x`` is 12)."""
    text = F.regexp_extract(_bare(cell), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    value = F.when(text != "", text).try_cast("double")
    return F.when(~is_missing(cell) & (F.abs(value) != float("inf")), value)
