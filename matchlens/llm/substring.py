"""Substring dedup by super-k-mer partitioning (operator 9).

A window is ``k`` consecutive words of one document.  Consecutive windows that share a
minimiser (the least hash of the ``m``-word sequences in a window) travel as one packed
string, a super-k-mer, to the minimiser's bucket; equal windows have equal minimisers, so
sorting a bucket's windows counts them exactly.

* Minimisers that occur in one document only cannot hold a shared window: an aggregate
  finds the shared ones, and a Bloom filter of them (bounded size) selects what travels.
* A minimiser of more than ``HOT`` super-k-mers would make a bucket of unbounded size: its
  windows are counted one by one in an aggregate that combines before the shuffle.
* Words are named by 40-bit hashes in packed strings, windows by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm import bloom
from matchlens.llm.common import _powers, find_words, fresh, hash_words, map_arrow, mix, rank_within, signed, slices, stored, windows

K, M = 50, 5
#: Windows in one super-k-mer at most (texts that repeat one phrase have endless ones).
MOST_WINDOWS = 256
HOT = 4_000
NAME_BYTES = 5
#: Words of a bucket's strings that are sorted together (whole buckets, so sometimes more).
SORT_WORDS = 1 << 19
#: Spans (8 bytes each, some 30 a document) that are broadcast to the texts; more meet them in a shuffle.
BROADCAST_SPANS = 200_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def super_kmers(h: np.ndarray, of: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of every super-k-mer, for word hashes
    *h* of documents with the word offsets *of*."""
    n, s = len(h) - k + 1, k - m + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.view(np.uint64)
    g = windows(h, m)
    padded = np.full(-(-len(g) // s) * s, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(g)] = g
    blocks = padded.reshape(-1, s)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[s - 1 : s - 1 + n])
    doc = rank_within(of, len(h))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    if not len(at):
        return empty, empty, empty.view(np.uint64)
    v = least[at]
    new = np.r_[True, (np.diff(at) != 1) | (v[1:] != v[:-1])]
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % MOST_WINDOWS == 0
    run = np.flatnonzero(new)
    return at[run], np.diff(np.append(run, len(at))), v[run]


def digests(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of the k words from each position in *at*."""
    out = []
    for base in _BASES:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ base) * _powers(base, max(len(h), 1))[: len(h)])])
        out.append(mix((sums[at + k] - sums[at]) * _powers(inverse, len(h) + 1)[at]))
    return out[0], out[1]


def _names(h: np.ndarray) -> np.ndarray:
    """The 40-bit names of words, as 64-bit values."""
    return h & np.uint64((1 << (8 * NAME_BYTES)) - 1)


def _scan(batches: Iterator[pa.RecordBatch], k: int, m: int):
    """Per slice: rows, word hashes, and the super-k-mers with their document and start in it."""
    for rows, data, offsets in slices(batches):
        starts, ends, of = find_words(data, offsets)
        h = hash_words(data, starts, ends)
        first, count, least = super_kmers(h, of, k, m)
        doc = np.searchsorted(of, first, "right") - 1
        yield rows, h, first, count, least, doc, first - of[doc]


def removed_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, _text_hash, start, length): words to remove, spans in words, overlaps included.

    *docs* has doc_id, _text_hash and text.  A word goes if it lies in a window
    that also starts in a document with a smaller doc_id.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    sc = docs.sparkSession.sparkContext

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, _, least, doc, _ in _scan(batches, k, m):
            order = np.lexsort((least, doc))
            d, v = doc[order], least[order]
            new = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])] if len(d) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            ids = rows.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(signed(v[at])), pa.array(ids[d[at]]), pa.array(np.diff(np.append(at, len(d))))], ["minimiser", "doc_id", "n"])

    found = map_arrow(docs.select("doc_id", "text"), minimisers, "minimiser long, doc_id long, n long")
    found = found.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.sum("n").alias("n"))
    shared = stored(found.where("a < b").select("minimiser", "n"))
    may = sc.broadcast(bloom.build(shared.select("minimiser")))
    very = shared.where(F.col("n") > HOT).select("minimiser")
    any_hot = not very.isEmpty()
    hot = sc.broadcast(bloom.build(very)) if any_hot else None

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, first, count, least, doc, start in _scan(batches, k, m):
            go = may.value.has(signed(least))
            if hot is not None:
                go &= ~hot.value.has(signed(least))
            first, count, least, doc, start = (x[go] for x in (first, count, least, doc, start))
            words = count + k - 1
            ends = np.cumsum(words)
            at = np.repeat(first - ends + words, words) + np.arange(ends[-1] if len(ends) else 0)
            packed = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[at, :NAME_BYTES])
            offsets = np.concatenate([[0], NAME_BYTES * ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(least)), rows.column("doc_id").take(pa.array(doc)), rows.column("_text_hash").take(pa.array(doc)), pa.array(start.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]),
                ],
                ["minimiser", "doc_id", "_text_hash", "start", "packed"],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive whole and in order; many are sorted at once."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("packed").nbytes
            if size >= NAME_BYTES * SORT_WORDS:
                t = pa.Table.from_batches(held).combine_chunks()
                least = t.column("minimiser").to_numpy()
                cut = int(np.searchsorted(least, least[-1], "left"))
                if cut:
                    yield from verdicts(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(b.column("packed").nbytes for b in held)
        if held:
            yield from verdicts(pa.Table.from_batches(held))

    def verdicts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        packed = t.column("packed").chunk(0)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, NAME_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :NAME_BYTES] = raw
        h = wide.view(np.uint64).ravel()
        word = (offsets - offsets[0]) // NAME_BYTES
        count = np.diff(word) - k + 1
        row = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        d1, d2 = digests(h, word[row] + nth, k)
        ids = t.column("doc_id").to_numpy()
        doc = ids[row]
        order = np.lexsort((doc, d2, d1))
        new = np.r_[True, (np.diff(d1[order]) != 0) | (np.diff(d2[order]) != 0)]
        run = np.flatnonzero(new)
        smallest = np.repeat(doc[order[run]], np.diff(np.append(run, len(order))))
        again = np.empty(len(order), bool)
        again[order] = doc[order] > smallest
        yield _runs(again, row, nth, t.column("doc_id"), t.column("_text_hash"), t.column("start").to_numpy(), k)

    key = "minimiser"
    sent = map_arrow(docs, travel, "minimiser long, doc_id long, _text_hash long, start int, packed binary")
    flags = map_arrow(sent.repartition(key).sortWithinPartitions(key), judge, _SPANS)
    if any_hot:
        flags = flags.unionByName(_hot_spans(docs, hot, k, m))
    return flags


_SPANS = "doc_id long, _text_hash long, start int, length int"


def _runs(again: np.ndarray, row: np.ndarray, nth: np.ndarray, ids, hashes, start: np.ndarray, k: int) -> pa.RecordBatch:
    """Spans of words from flagged windows: consecutive ones of a row make one span."""
    at = np.flatnonzero(again)
    r, w = row[at], nth[at]
    new = np.r_[True, (r[1:] != r[:-1]) | (np.diff(w) != 1)] if len(at) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(at))) + k - 1
    take = pa.array(r[run])
    columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids.take(take), hashes.take(take))]
    return pa.RecordBatch.from_arrays([*columns, pa.array((start[r[run]] + w[run]).astype(np.int32)), pa.array(length.astype(np.int32))], ["doc_id", "_text_hash", "start", "length"])


def _hot_spans(docs: DataFrame, hot, k: int, m: int) -> DataFrame:
    """As buckets, for minimisers of very many documents: an aggregate by window digest."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, first, count, least, doc, start in _scan(batches, k, m):
            go = hot.value.has(signed(least))
            first, count, doc, start = (x[go] for x in (first, count, doc, start))
            row = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            d1, d2 = digests(_names(h), first[row] + nth, k)
            take = pa.array(doc[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(d1)), pa.array(signed(d2)), rows.column("doc_id").take(take), rows.column("_text_hash").take(take), pa.array((start[row] + nth).astype(np.int32))],
                ["d1", "d2", "doc_id", "_text_hash", "start"],
            )

    each = map_arrow(docs, single, "d1 long, d2 long, doc_id long, _text_hash long, start int")
    # Only digests of two documents or more matter; both aggregates combine before the shuffle.
    first = each.groupBy("d1", "d2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    later = each.join(first.drop("_last"), ["d1", "d2"]).where("doc_id > _first")
    return later.select("doc_id", "_text_hash", "start", F.lit(k).alias("length"))


def _cut(docs: DataFrame, k: int, m: int, keep: list[str], names: tuple[str, str, str], in_place: bool) -> DataFrame:
    """The columns *keep* of *docs*, and those of *names*; with *in_place* the text itself is
    what is kept of it (unchanged where no word goes), and there is no third."""
    n_words, n_removed, kept_text = names
    text_hash, spans_name, key, span_id, span_hash = fresh(docs, "_text_hash", "_spans", "_key", "_span_id", "_span_hash")
    if "doc_id" not in keep:
        raise ValueError("doc_id must be among the columns that are kept")
    spans = removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_hash"), "text"), k, m)
    spans = stored(spans.groupBy("doc_id", "_text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_spans")))
    schema = docs.select(*keep).schema.add(n_words, "long").add(n_removed, "long")
    schema = schema if in_place else schema.add(kept_text, "string")
    out_names = schema.names

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            raw = data.tobytes()
            _, _, of = find_words(data, offsets)
            total = np.diff(of)
            gone, kept = np.zeros(len(total), np.int64), []
            have = spans_name in rows.schema.names
            touched = rows.column(spans_name).is_valid().to_numpy(zero_copy_only=False) if have else np.zeros(len(total), bool)
            for i in range(len(total)) if not in_place else np.flatnonzero(touched).tolist():
                words = raw[offsets[i] : offsets[i + 1]].split()
                if touched[i]:
                    own = rows.column(spans_name)[i].values
                    start, length = (own.field(c).to_numpy() for c in ("start", "length"))
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                    gone[i] = len(words) - len(left)
                    words = [words[j] for j in left]
                kept.append(b" ".join(words))
            columns = [rows.column(c) for c in keep]
            if in_place:
                if touched.any():
                    new = rows.column("text").to_pylist()
                    for i, x in zip(np.flatnonzero(touched).tolist(), kept, strict=True):
                        new[i] = x.decode() if gone[i] else new[i]
                    columns[keep.index("text")] = pa.array(new, pa.string())
            else:
                kept = [pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(gone), *([] if in_place else kept)], out_names)

    wanted = keep if "text" in keep else [*keep, "text"]
    marked = docs.select(*wanted).withColumn(text_hash, F.xxhash64("text"))
    named = spans.select(F.col("doc_id").alias(span_id), F.col("_text_hash").alias(span_hash), F.col("_spans").alias(spans_name))
    on = (F.col("doc_id").cast("long") == F.col(span_id)) & (F.col(text_hash) == F.col(span_hash))
    if (spans.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        return map_arrow(marked.join(F.broadcast(named), on, "left").select(*wanted, spans_name), finish, schema)
    # Rows that certainly have no span need no join; only the others' texts are shuffled.
    with_key = marked.withColumn(key, F.coalesce(F.xxhash64(F.col("doc_id").cast("long"), F.col(text_hash)), F.lit(0)))
    filter_ = bloom.build(spans.select(F.xxhash64("doc_id", "_text_hash")))
    maybe = bloom.chosen(with_key, key, filter_, True)
    rest = bloom.chosen(with_key, key, filter_, False).select(*wanted)
    maybe = maybe.join(named.hint("merge"), on, "left")
    return map_arrow(rest, finish, schema).unionByName(map_arrow(maybe.select(*wanted, spans_name), finish, schema))


def dedup(docs: DataFrame, k: int = K, m: int = M, columns: list[str] | None = None) -> DataFrame:
    """The *columns* of *docs* (default: all) with n_words, n_removed and kept_text (the kept
    words joined by one space).

    Every word goes that lies in a window of *k* words that also starts in a document
    with a smaller doc_id; windows are judged on the input.  A null text has no words and
    an empty kept_text; texts shorter than a window, and rows without a doc_id, keep all.
    Rows that share a doc_id keep what they share with each other.  Other columns are
    passed on; those named n_words, n_removed, kept_text are replaced.
    """
    new = ("n_words", "n_removed", "kept_text")
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in new]
    return _cut(docs, k, m, keep, new, False)


def clean(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """*docs* without the words that dedup() removes, and without documents that lose all of theirs.

    Texts that lose none stay as they are; those that do are the kept words joined by one
    space.  Only text changes, and n_chars where the table has such a column and the text changed."""
    n_words, n_removed, _ = names = tuple(fresh(docs, "n_words", "n_removed", "kept_text"))
    out = _cut(docs, k, m, list(docs.columns), names, True).where((F.col(n_removed) < F.col(n_words)) | (F.col(n_words) == 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
