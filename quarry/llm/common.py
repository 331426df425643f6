"""Shared plumbing of the training-data operators: scratch tables, text chunks, word hashing.

Every helper is written for recovery from lost executors: state between steps lives in Parquet
tables below ``spark.checkpoint.dir`` and never in executor-local storage.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import delete, scratch_root

#: Text bytes that one numpy pass works on.
CHUNK_BYTES = 6 << 20
#: The same where words are hashed, which takes some 50 bytes for each.
HASH_BYTES = 3 << 19
#: Rows in an Arrow batch sent to Python; long texts make large batches.
BATCH_ROWS = 512


class Scratch:
    """Parquet tables of one operator run, in the shared folder.

    Steps drop what no later step reads; the rest goes with ``clear_scratch``, or when the driver's program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_root(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and computes it once."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives freed memory back at its end: workers wait for more tasks, and hold what they have."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` whose column ``n`` tells how many of the ``total`` rows each of its entries meets.

    Entries that meet more than a thousandth of the rows would fill single tasks. There are less than a thousand of
    them, so these go to the rows instead of the rows to them; all others meet in a shuffle.
    """
    limit = max(1000, total // 1000)
    hot, cold = table.where(F.col("n") > limit).drop("n"), table.where(F.col("n") <= limit).drop("n")
    near = rows.join(F.broadcast(hot), on, how)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return near.unionByName(rest.join(cold, on, how))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(rows: int, each: int) -> int:
    """Buckets for ``rows`` entries of about ``each`` per bucket; grows with the data, at least 1."""
    return max(1, -(-int(rows) // each))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many more underscores before it as no column has (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_array(column) -> pa.Array:
    """A null-free string array from an Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``limit`` bytes of ``text``; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = np.diff(offsets_of(text_array(batch.column(batch.schema.get_field_index(text)))))
        while at < batch.num_rows:
            room = np.cumsum(lengths[at:])
            n = max(1, int(np.searchsorted(room, limit - size, side="right")))
            if held and size + room[n - 1] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, n))
            size += int(room[n - 1])
            at += n
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def offsets_of(arr: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, from its first row on."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(arr.buffers()[1], kind, count=len(arr) + 1 + arr.offset)
    return raw[arr.offset :].astype(np.int64)


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes as one uint8 array, and each row's offsets into it."""
    offs = offsets_of(arr)
    if len(arr) == 0 or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


# --- hashing -------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a published public-domain mixer) on uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word that are hashed together with other words.
LONG_WORD = 64
#: 1 for the bytes that part words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space parted words of every row, and each row's first word number."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, np.bool_)
    edge[offs] = True  # rows part words too
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased in A-Z if ``fold``: eight bytes a round, mixed in turn; long words by xxh3."""
    import xxhash

    if not len(starts):
        return np.zeros(0, np.uint64)
    low = _LOWER[data] if fold else np.ascontiguousarray(data)
    eight = eights(low)
    left = ends - starts
    out = mix(left.astype(np.uint64) + _ODD)
    at, place = np.arange(len(starts)), starts
    for _ in range(LONG_WORD // 8):
        part = eight[place] & _FIRST[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ part)
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
        if not len(at):
            return out
    raw = memoryview(low)
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out
