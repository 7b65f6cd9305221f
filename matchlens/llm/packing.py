"""Best-fit packing with Martello-Toth dominance reduction (operator 3).

Every document becomes pieces of at most ``capacity`` tokens.  How many pieces have each
length is all that a packing depends on, and that histogram has ``capacity`` entries at
any input size: the driver reduces it (pairs and singles that provably dominate every
other choice are fixed), best-fits the rest, and returns the packing as intervals of
ranks within a length.  Pieces then find their sequence by their rank.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import map_arrow, slices, stored

#: Pieces ranked together in one window partition.
RANK_ROWS = 100_000
#: Distinct pretokens a worker remembers, and the longest of them in characters.
CACHE_WORDS, CACHE_CHARS = 150_000, 32

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file by bytes, if its ids are in merge order."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(model["vocab"]) != 256 + len(merges):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}


class Encoder:
    """Ids of whole texts by a byte-level BPE file, as little-endian 32-bit bytes.

    Before a space that follows a non-space a new pretoken always begins, and a line feed
    between non-spaces is one; so texts whose spaces are single blanks or line feeds are
    cut there, and the ids of a word met again come from memory.  Other texts are cut by
    the pretoken pattern.  Those with code points from U+0500 on, controls, or a special
    token's string go to the tokenizer whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self._special = [t["content"].encode() for t in json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens", [])]
        # Most texts never need it, and it takes memory.
        self._tokenizer = functools.cache(lambda: Tokenizer.from_file(path))
        self._cut = regex.compile(pattern).findall
        ranks = _byte_ranks(path)
        if ranks is None:
            encode = lambda text: self._tokenizer().encode(text, add_special_tokens=False).ids
        else:
            encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def remembering(shape: Callable[[str], str]) -> Callable[[list[str]], bytes]:
            """Ids of a list of words, each given its *shape* first."""
            known: dict[str, bytes] = {}
            get = known.get

            def ids_of(words: list[str]) -> bytes:
                found = list(map(get, words))
                if None in found:
                    for i, word in enumerate(words):
                        if found[i] is None:
                            found[i] = get(word) or np.asarray(encode(shape(word)), "<u4").tobytes()
                            if len(word) <= CACHE_CHARS:
                                if len(known) >= CACHE_WORDS:
                                    known.clear()
                                known[word] = found[i]
                return b"".join(found)

            return ids_of

        # A word of a cut at spaces had a blank before it, unless it is a line feed or marked.
        self._pretokens = remembering(lambda w: w)
        self._words = remembering(lambda w: w if w == "\n" else w[1:] if w[:1] == "\x02" else " " + w)

    def __call__(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        values = np.frombuffer(raw, np.uint8)
        kinds = np.bincount(values, minlength=256)
        if kinds[0xD4:].any() or kinds[:9].any() or kinds[0x0E:0x20].any() or any(s in raw for s in self._special):
            return np.asarray(self._tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # U+0085, U+00A0 and the like are spaces too; they begin with C2 here.
        blank = (values == 32) | (values == 10)
        if kinds[[9, 11, 12, 13]].any() or kinds[0xC2] or (blank[1:] & blank[:-1]).any():
            return self._pretokens(self._cut(text))
        return self._words(("\x02" + text.replace("\n", " \n \x02")).split(" "))


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str | None) -> Encoder:
    """One for each Python worker, which keeps what it has encoded from task to task."""
    import public_tokenizers

    return Encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of every row of *docs*; only the first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for rows, data, offsets in slices(batches):
            out: list[tuple] = []
            raw = data.tobytes()
            for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                ids = encode(raw[offsets[i] : offsets[i + 1]]) + end
                n = len(ids) // 4
                at = 0
                for piece in range(-(-n // capacity)):
                    to = at + ((n - 1) % capacity + 1 if piece == 0 else capacity)
                    out.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECE_SCHEMA)


Bins = list[tuple[tuple[int, ...], int]]


def reduce_by_dominance(counts: list[int], capacity: int) -> Bins:
    """Fix item sets that some optimal packing contains, and take them out of *counts*.

    For an item of size w with r = capacity - w left beside it, and s the largest other
    item that fits there: {w} alone if there is no s; {w, s} if s fills r exactly, if no
    two others fit together, or if no three fit and no two that fit exceed s (they could
    change places with s).  Largest sizes first, again until nothing is fixed.
    """
    fixed: Bins = []
    while True:
        before = len(fixed)
        for w in range(capacity, 0, -1):
            while counts[w]:
                counts[w] -= 1
                r = capacity - w
                sizes = [s for s in range(1, r + 1) if counts[s]]
                counts[w] += 1
                if not sizes:
                    fixed.append(((w,), counts[w]))
                    counts[w] = 0
                    break
                s = sizes[-1]
                if s != r:
                    least = [x for x in sizes for _ in range(min(3, counts[x] - (x == w)))][:3]
                    if len(least) > 1 and least[0] + least[1] <= r:
                        if len(least) > 2 and sum(least) <= r:
                            break
                        pair = 0
                        for a in sizes:
                            j = bisect.bisect_right(sizes, r - a) - 1
                            if j >= 0 and sizes[j] == a and counts[a] - (a == w) < 2:
                                j -= 1
                            if j >= 0:
                                pair = max(pair, a + sizes[j])
                        if pair > s:
                            break
                m = counts[w] // 2 if s == w else min(counts[w], counts[s])
                fixed.append(((w, s), m))
                counts[w] -= m
                counts[s] -= m
        if len(fixed) == before:
            return fixed


def best_fit(counts: list[int], capacity: int) -> Bins:
    """Best-fit decreasing of the sizes in *counts*; equal bins are handled together."""
    bins: list[list] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(sizes: tuple[int, ...], times: int, left: int) -> None:
        free[left].append(len(bins))
        bins.append([sizes, times])

    for w in range(capacity, 0, -1):
        n = counts[w]
        while n:
            left = next((r for r in range(w, capacity) if free[r]), None)
            if left is None:
                k = capacity // w
                if n >= k:
                    put((w,) * k, n // k, capacity - k * w)
                if n % k:
                    put((w,) * (n % k), 1, capacity - n % k * w)
                n = 0
                continue
            at = free[left].pop()
            sizes, times = bins[at]
            t = min(n, times)
            if t < times:
                bins[at][1] -= t
                free[left].append(at)
                put((*sizes, w), t, left - w)
            else:
                bins[at][0] = (*sizes, w)
                free[left - w].append(at)
            n -= t
    return [(s, t) for s, t in bins]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) for all pieces."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    bins = reduce_by_dominance(counts, capacity)
    bins += best_fit(counts, capacity)
    given = [0] * (capacity + 1)
    out, sequence = [], 0
    for sizes, times in bins:
        offset = 0
        for w in sizes:
            out.append((w, given[w], given[w] + times - 1, sequence, offset))
            given[w] += times
            offset += w
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack every row of *docs* (doc_id, text) into sequences of at most *capacity* tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset.  A
    null or empty text is one piece that holds the end id alone; repeated rows are packed
    as often as they occur; an empty table gives no rows; other columns are ignored.
    *tokenizer* is the path of a byte-level BPE file (default: the public 50k one).
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    intervals = spark.createDataFrame(plan(histogram, capacity), "length long, first long, last long, base long, offset long")
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    before = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    return (
        ranked.join(F.broadcast(intervals), "length")
        .where(F.col("_rank").between(F.col("first"), F.col("last")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")
    )
