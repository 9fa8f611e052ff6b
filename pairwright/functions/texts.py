"""Numbers as Python writes them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _python_text(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else repr(v) for v in values.to_pylist()], pa.string())


def number_text(value: Column) -> Column:
    """A double as Python's ``str`` gives it: the fewest digits that name it, an exponent below 1e-4 and from 1e16 on; null stays null.

    Java before version 19 writes some doubles with a digit too many, so this is told in Arrow batches.
    """
    return F.arrow_udf(_python_text, "string")(value.cast("double"))
