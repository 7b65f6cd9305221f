"""Bloom filters of 64-bit keys that Spark builds in parallel and broadcasts.

The filter has at most ``2 ** MAX_BITS`` bits (32 MB) whatever the input; with more keys
it only lets more false positives through, which the callers sort out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import fresh, map_arrow, mix

MIN_BITS, MAX_BITS = 16, 28
BITS_PER_KEY = 10
#: Keys (8 bytes each) that are broadcast as they are.
BROADCAST_KEYS = 1_000_000
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for seed in _SEEDS:
        yield mix(keys.view(np.uint64) ^ seed) >> np.uint64(64 - bits)


class Bloom:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.asarray([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which 64-bit keys may be in the set (False is certain)."""
        out = np.ones(len(keys), bool)
        for at in _places(np.ascontiguousarray(keys), self.bits):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def build(keys: DataFrame) -> Bloom:
    """A filter of the first column of *keys* (long, no nulls)."""
    n = keys.count()
    bits = int(min(max(int(n * BITS_PER_KEY).bit_length(), MIN_BITS), MAX_BITS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for at in _places(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], ["at", "marks"])

    marks = map_arrow(keys, mark, "at long, marks long").groupBy("at").agg(F.bit_or("marks").alias("marks")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[marks.column("at").to_numpy()] = marks.column("marks").to_numpy().astype(np.int64).view(np.uint64)
    return Bloom(words, bits)


def chosen(rows: DataFrame, column: str, known: Bloom, inside: bool) -> DataFrame:
    """The *rows* whose *column* (long, no nulls) may be in the filter, or those for which it certainly is not."""
    known = rows.sparkSession.sparkContext.broadcast(known)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column(column).to_numpy()) == inside))

    return map_arrow(rows, choose, rows.schema)


def semi(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The *rows* whose *column* (long, no nulls) may be among *keys* (one column): all that are, and few others."""
    return chosen(rows, column, build(keys), True)


def without(rows: DataFrame, column: str, keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The *rows* whose *column* (long; null stays) is none of *keys* (one column of that name).

    Up to *most* keys are broadcast; of more, a filter lets rows that are certainly none of
    them pass, so that only the others are shuffled."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), column, "left_anti")
    (own,) = fresh(rows, "_filtered")
    marked, known = rows.withColumn(own, F.coalesce(F.col(column), F.lit(0))), build(keys)
    maybe = chosen(marked, own, known, True).join(keys.hint("merge"), column, "left_anti")
    return chosen(marked, own, known, False).unionByName(maybe.select(*marked.columns)).select(*rows.columns)
