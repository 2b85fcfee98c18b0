"""Applying a Python function to text rows in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of input that a function gets at once, unless a single row has more.
SLICE_BYTES = 8_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's bytes in an Arrow batch to SLICE_BYTES, if they are more: batches of
    10 000 long texts would fill a task's memory on both sides of the pipe."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING, None)
    if now is None or not now.isdigit() or int(now) > SLICE_BYTES:
        conf.set(BATCH_SETTING, str(SLICE_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: workers outlive tasks, and the next stage's need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over bounded batches, giving memory back at the end of each task."""
    bound_batches(df)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with a function that is made once per task.

    make() returns a function from a batch to columns by name; the columns may
    be longer or shorter than the batch.  Memory is bounded by a batch and what
    comes of it.  Workers outlive tasks: the function's attribute `close`, if it
    has one, is called when the task ends.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                rows = max(1, batch.num_rows * slice_bytes // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, rows):
                    columns = work(batch.slice(at, rows))
                    arrays = [_column(columns[f.name], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            getattr(work, "close", lambda: None)()

    return map_stream(df, run, schema)
