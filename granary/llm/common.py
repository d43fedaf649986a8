"""What the operators share: reading tables, shared scratch tables, and views of Arrow text as numpy bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir. Where that is unset the session must be a local one (tests), and a fresh
    temporary folder is used; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return made


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost executor
    costs a read, not a recomputation. The shuffle files that made it are freed once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


Batches = Iterator[pa.RecordBatch]
#: Of what Spark sends to a Python worker at once; a longer row comes alone.
BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def release() -> None:
    """Gives back to the system what this Python worker has freed, and the table of powers."""
    _powers[:] = [_powers[0][:1], _powers[1][:1]]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) by batches of BATCH_BYTES, unless the session has another size. Workers outlive
    tasks, so what a task needed goes when it ends."""

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    if BATCH_SIZE not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SIZE, BATCH_BYTES)
    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, column: int, block_bytes: int = 1 << 20) -> Batches:
    """The batch in parts of about block_bytes of text in that column; a longer row comes alone."""
    for lo, hi, _, _ in utf8_blocks(batch.column(column), block_bytes):
        yield batch.slice(lo, hi - lo)


def utf8_blocks(column: pa.Array, block_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) of a string or binary column as one byte array with offsets, about block_bytes at a time.

    A null counts as empty. A longer row comes whole, as a block of its own.
    """
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, empty = np.int32, ("" if pa.types.is_string(column.type) else b"")
    else:
        kind, empty = np.int64, ("" if pa.types.is_large_string(column.type) else b"")
    column = pc.fill_null(column, empty)
    _, raw_offsets, raw = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(raw_offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers that are kept: those of a usual block.
POWERS = 1 << 20 | 1 << 12
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n. A table of 16 MB is kept while a task runs; a longer one is not kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, POWERS), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= POWERS:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of value[byte] * base**position: any substring's hash is a difference times base**-start."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data))[0], out=sums[1:])
    return sums


#: Words end at white space only: space and the control characters 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

#: Words are runs of ASCII letters, digits and bytes of other characters.
NOT_WORD = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_WORD[_lo:_hi] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: First bytes of the characters U+3000 to U+9FFF, of scripts that put no spaces between words.
NO_SPACES = np.zeros(256, bool)
NO_SPACES[0xE3:0xEA] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, A-Z lower-cased, and each row's first word (one more at the end).

    alone: first bytes of characters of three bytes that are words by themselves.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    if alone is not None:
        lead = alone[data]
        first |= lead
        first[3:] |= lead[:-3] & inside[3:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(_LOWER[data])
    hashes = mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, by the first word's place; rows' borders are the caller's concern."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)
