"""Column functions of one value in Python, with few Python objects at a time.

Spark hands a batch over as Arrow, of at most ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB) or a row.  Its values
become Python objects some rows at a time, and results go back to Arrow as often, so a task's memory is that of a
batch and its results, however many rows of whatever size there are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

ROWS = 16


def in_parts(column: pa.Array, one: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """The function's value of each value (nulls too), as an array of that type."""
    parts = [pa.array([one(x) for x in column.slice(k, ROWS).to_pylist()], kind) for k in range(0, len(column), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def per_value(kind: DataType) -> Callable[[Callable[[Any], Any]], Callable]:
    """Makes a column function of a function of one value."""

    def make(one: Callable[[Any], Any]) -> Callable:
        @F.arrow_udf(kind)
        def mapped(column: pa.Array) -> pa.Array:
            return in_parts(column, one, to_arrow_type(kind))

        return mapped

    return make
