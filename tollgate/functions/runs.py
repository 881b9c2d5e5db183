"""Python functions over text columns that hold the Python objects of few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

RUN_BYTES = 1 << 20
RUN_ROWS = 1024


def row_bytes(column: pa.Array) -> np.ndarray:
    """About how many bytes each row holds, in texts or lists of texts."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        inside = np.concatenate([[0], np.cumsum(row_bytes(column.flatten()))])
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)), dtype=np.int64)
        return np.diff(inside[np.concatenate([[0], ends])]) + 8
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 8
    return np.full(len(column), 8, np.int64)


def runs(column: pa.Array, limit: int = RUN_BYTES, rows: int = RUN_ROWS) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``limit`` bytes and ``rows`` rows, one row at least."""
    ends = np.cumsum(row_bytes(column))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + limit, "right"))), at + rows)
        yield column.slice(at, to - at)
        at = to


def in_runs(
    make: Callable[[], Callable[[pa.Array], list | pa.Array]], kind: str, limit: int = RUN_BYTES, rows: int = RUN_ROWS, once: bool = True
) -> Callable[[Column], Column]:
    """A function on columns. ``make()`` runs once per task; what it gives turns a slice of a batch into as many values.

    A batch arrives as Arrow memory. Only one slice of it at a time becomes Python objects, and its results leave
    before the next one is read, so a task's memory hardly grows with the rows and bytes of its batches.

    With ``once`` the function counts as not deterministic. Spark derives a filter from every generator (its array is not
    empty), and moves filters with a copy of the function below a repartition, where few tasks would run it a second time.
    """
    values = to_arrow_type(DataType.fromDDL(kind))

    @arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            for part in runs(batch, limit, rows):
                found = each(part)
                if not isinstance(found, pa.Array):
                    found = pa.array(found, values)
                yield found if found.type == values else found.cast(values)

    return run.asNondeterministic() if once else run


def list_rows(matrix: np.ndarray, given: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as lists; with ``given``, null in the other places."""
    width = matrix.shape[1]
    if given is None:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * width, pa.int32()), pa.array(matrix.ravel()))
    offsets = np.concatenate([[0], np.cumsum(given * width)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel()), mask=pa.array(~given))
