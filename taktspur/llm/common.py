"""Helpers shared by the operators: worker caches, whole-batch hashing of words and n-grams.

Texts are handled in slices of about ``SLICE_BYTES``, so memory follows the slice (or the one
text that is longer), not the Arrow batch.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_run_dir

SLICE_BYTES = 1 << 20
ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def once(key, make):
    """``make()`` run once per Python process; functions travel by value, so modules keep no state."""
    kept = sys.__dict__.setdefault("_taktspur_once", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def with_small_batches(docs: DataFrame) -> DataFrame:
    """The same frame, with the session's Arrow batches lowered to 1,000 rows and 16 MB.

    Rows are whole texts here; the default of 10,000 rows would hold tens to hundreds of MB at once
    in both processes.
    """
    conf = docs.sparkSession.conf
    for key, most in ((ROWS_KEY, 1000), (BYTES_KEY, 16 << 20)):
        now = int(conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return docs


def crc_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % buckets


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet to the shared folder and read from there."""
    spark: SparkSession = df.sparkSession
    path = new_run_dir(spark, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of consecutive slices; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed multipliers of splitmix64): near inputs give unrelated outputs."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    return once("byte values", lambda: mix(np.arange(1, 257, dtype=np.uint64) * BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    kept = sys.__dict__.setdefault("_taktspur_once", {})
    if len(kept.get("powers", ((),))[0]) < n:
        size = max(n, SLICE_BYTES + 2)
        up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * SLICE_BYTES:
            return pair
        kept["powers"] = pair
    return kept["powers"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` reads the hash of any span off them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data) + 1)[0][:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def ascii_lower(data: np.ndarray) -> np.ndarray:
    table = once("lower", lambda: np.array(
        [b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8))
    return table[data]


def space_table() -> np.ndarray:
    """True at the bytes that part words: blank and \\x09 to \\x0D."""
    return once("space", lambda: np.array([b == 32 or 9 <= b <= 13 for b in range(256)]))


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    inside = ~space_table()[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def as_texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
