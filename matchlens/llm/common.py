"""Shared helpers: reading tables, shared-folder tables, and word extraction in numpy.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; working on UTF-8 bytes is
exact because those separators are single bytes that never occur inside a longer code
point.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.sources.shared import shared_dir

#: Pieces of text handled at once in a Python worker; a longer document is its own piece.
SLICE_BYTES = 1 << 20
#: Bytes hashed at once: the power tables of that length stay in the CPU's cache.
SPAN = 1 << 15

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


#: A random-looking 64-bit value for each byte; the second maps A-Z to a-z first.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW, _IPOW = _powers(_BASE, SPAN), _powers(_INV, SPAN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether Spark deletes an execution's shuffle files as soon as it ends, not when the driver happens to collect its garbage.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of *df* as a written table in the shared folder: lineage ends there, a lost
    executor costs no recomputation of what came before, and the shuffles that led to it go."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEAN_KEY)
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(amount: int, least: int, whole: int, most: int) -> int:
    """Into how many parts of at least *least* to cut a work of *amount* so that none is more than one *most*-th of *whole*."""
    return max(1, -(-amount // max(least, -(-whole // most))))


#: Bytes of rows that Spark sends to a Python worker at once, where the session sets no other limit.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def release() -> None:
    """Give freed memory back to the system: a worker that idles shares its executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow() in batches of bounded bytes, by workers that give their memory back."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as no column of *df* has (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (of a null: none), and the n + 1 offsets of its values."""
    if arr.null_count:
        arr = arr.fill_null(pa.scalar(b"").cast(arr.type))
    large = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in pieces of about *most* bytes of *col*: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = buffer_of(batch.column(col))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
            j = min(max(j, i + 1), batch.num_rows)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for n documents the n + 1 word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_WS[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~word[:-1]
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(word & first)
    last = np.empty(n, bool)
    last[:-1], last[-1] = first[1:] | ~word[1:], True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes from prefix sums, mixed."""
    out = np.empty(len(starts), np.uint64)
    values, i = _BYTE_LOWER if lower else _BYTE, 0
    while i < len(starts):
        a = int(starts[i])
        j = max(int(np.searchsorted(ends, a + SPAN - 1, "right")), i + 1)
        b = int(ends[j - 1])
        n = b - a
        p, ip = (_POW, _IPOW) if n < SPAN else (_powers(_BASE, n + 1), _powers(_INV, n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[a:b]] * p[:n], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * ip[s]
        i = j
    return mix(out)


def rank_within(offsets: np.ndarray, n: int) -> np.ndarray:
    """For n items dealt to documents by *offsets*: the document of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, in order (k - 1 fewer than there are)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
