"""Rows through Python in batches that are bounded by bytes on both sides, whatever the size of the input."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Of what Spark sends to a Python worker at once, and of what comes back; a longer row comes alone.
BATCH_SIZE, BATCH_BYTES, MADE_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 2 << 20
#: What a number or a null counts for; rows that are objects of Python at once.
FIELD, ROWS = 16, 64


def weight(value: object) -> int:
    """About the bytes of a value."""
    if isinstance(value, (str, bytes)):
        return FIELD + len(value)
    if isinstance(value, dict):
        return FIELD + sum(map(weight, value.values()))
    return FIELD + sum(map(weight, value)) if isinstance(value, (list, tuple)) else FIELD


def release() -> None:
    """Gives back to the system what this Python worker has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session that sends BATCH_BYTES to Python at once, unless it has another size."""
    if BATCH_SIZE not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SIZE, BATCH_BYTES)
    return df


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of about so many rows, whatever the files are: for narrow rows with much work for each."""
    return df.repartition(max(1, -(-df.count() // rows)))


def through(batches: Iterable[pa.RecordBatch], own: Callable[..., Iterable[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What own(*row) gives for each row of batches, in batches of about MADE_BYTES; few rows are objects at once."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, ROWS).columns), strict=True):
                for out in own(*row):
                    held.append(out)
                    size += weight(out)
                    if size >= MADE_BYTES:
                        yield made(held)
                        held, size = [], 0
    if held:
        yield made(held)


def flat_map(df: DataFrame, each: Callable, schema: str, load: bool = False) -> DataFrame:
    """The rows (schema) that each(*row) gives for each row of df. With load, each() gives that function, once in each task."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from through(batches, each() if load else each, kinds)
        finally:
            release()

    return bounded(df).mapInArrow(run, schema)
