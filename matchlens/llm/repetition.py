"""Quality rules on repetition inside a text, from suffix arrays over words (operator 8).

The suffixes of many documents are ranked together by prefix doubling (a document's
number leads, so that suffixes of different documents never compare equal).  The ranks of
each level give the longest common prefix of neighbours in the suffix array by descending
powers of two.  The larger of a suffix's two neighbour prefixes is the length of its
deepest LCP interval, i.e. of the longest maximal repeat that starts there; the union of
those spans is what repeats cover.

The ranks of a level take four bytes a word, and there are as many levels as the longest
repeat has bits; a text of more than ``LONG_WORDS`` words, whose levels would not fit a
worker, has the same figures from sorted hashes of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import _BASE, _INV, _powers, find_words, fresh, hash_words, map_arrow, mix, rank_within, slices, windows

#: Shortest repeat, in words, that counts as covered text.
MIN_REPEAT = 10
#: A text is kept while repeats of that length cover at most this part of its words (the
#: published limit for 10-grams of MassiveText, Rae et al. 2021, table A1) ...
MAX_COVERED = 0.1
#: ... and its longest repeat has at most so many words (one fewer than a window of substring dedup).
MAX_LONGEST = 49
#: Words from which on a text's levels are not kept.
LONG_WORDS = 1 << 21

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_covered long, longest_repeat long, base_failed boolean, kept boolean"


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of *keys* and the dense rank of each position."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return order, rank


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest repeat that starts there.

    *words* are word identities and *doc* the (ascending) document of each; a repeat
    occurs at least twice in one document, overlaps included.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    _, w = _dense(words)
    levels = [_dense(doc * (int(w.max()) + 1) + w)[1].astype(np.int32)]
    width = 1
    # At level k a rank names the 2**k words from a position on (fewer at a document's end).
    while True:
        rank = levels[-1].astype(np.int64)
        shared = np.bincount(rank)[rank] > 1
        if not shared.any():
            break
        at = np.flatnonzero(shared)
        ahead = at + width
        second = np.zeros(len(at), np.int64)
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[at[inside]]
        second[inside] = rank[ahead[inside]] + 1
        _, fine = _dense(rank[at] * (n + 1) + second)
        # Ranks need only be distinct names in suffix order: those split off keep it.
        counts = np.bincount(rank, minlength=rank.max() + 1)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        new = first[rank]
        base = np.zeros(n, np.int64)
        base[at] = fine
        lowest = np.full(len(counts), n, np.int64)
        np.minimum.at(lowest, rank[at], fine)
        sizes = np.bincount(fine)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        new[at] += starts[fine] - starts[lowest[rank[at]]]
        levels.append(new.astype(np.int32))
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    near = doc[a] == doc[b]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(near & (levels[0][a] == levels[0][b]))
    a, b = a[live], b[live]
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, n)
    end = ends[doc[np.minimum(a, n - 1)] - doc[0]] if len(ends) == doc[-1] - doc[0] + 1 else ends[np.searchsorted(ends, a, "right")]
    for k in range(len(levels) - 1, -1, -1):
        ok = np.maximum(a, b) + (1 << k) <= end
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        step = np.where(ok, 1 << k, 0)
        common[live] += step
        a, b = a + step, b + step
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans from *starts* cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def _window_repeats(h: np.ndarray, k: int) -> np.ndarray:
    """Which windows of *k* words of one text occur in it twice or more (by 64-bit hashes)."""
    g = windows(h, k) if k <= 64 else _long_windows(h, k)
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    out = np.zeros(len(g), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _long_windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every *k* consecutive values, from prefix sums."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, inverse = _powers(_BASE, len(h) + 1), _powers(_INV, len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * p[:-1])])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def long_text(h: np.ndarray, min_repeat: int) -> tuple[int, int, int]:
    """Of one text by its word hashes: words in repeated 3-word windows, words that repeats of
    *min_repeat* words or more cover, and the longest repeat.

    Every part of a repeat repeats, so its windows of the least length cover the same
    words, and the longest is found by halving."""

    def cover(k: int) -> int:
        at = np.flatnonzero(_window_repeats(h, k))
        return int(covered(at, np.full(len(at), k), len(h)).sum())

    low, high = 0, len(h)
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if _window_repeats(h, k).any() else (low, k - 1)
    return cover(3), cover(min_repeat), low


def _counts(h: np.ndarray, of: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As long_text(), for every text of a slice."""
    total = np.diff(of)
    if len(total) == 1 and total[0] > LONG_WORDS:
        return tuple(np.asarray([x], np.int64) for x in long_text(h, min_repeat))
    doc = rank_within(of, len(h))
    longest = repeats(h, doc)

    def spans(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.bincount(doc[covered(at, lengths, len(doc))], minlength=len(total))

    three, long = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_repeat)
    most = np.zeros(len(total), np.int64)
    np.maximum.at(most, doc, longest)
    return spans(three, np.full(len(three), 3)), spans(long, longest[long]), most


def assess(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, columns: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """The *columns* of *docs* (default: all) with the counts and verdicts of COLUMNS, for whole texts.

    n_repeat_words counts words in 3-word windows found twice or more; repeat_covered
    those in repeats of *min_repeat* words or more; longest_repeat is in words.
    base_failed: fewer than 50 words, or more than half of them repeat in 3-word windows.
    kept: not base_failed, and the covered part and the longest repeat are within their
    limits.  Null and empty texts have no words and fail; repeated rows get equal verdicts.
    *names* maps those of COLUMNS that are wanted to their names in the result (default:
    all, by their own); columns of *docs* with these names are replaced.
    """
    kinds = dict(c.split() for c in COLUMNS.split(", "))
    names = {c: c for c in kinds} if names is None else names
    taken = {x.lower() for x in names.values()}
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in taken]
    schema = docs.select(*keep).schema
    for c, name in names.items():
        schema = schema.add(name, kinds[c])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            n, raw = rows.num_rows, data.tobytes()
            starts, ends, of = find_words(data, offsets)
            repeat, cover, most = _counts(hash_words(data, starts, ends), of, min_repeat)
            total = np.diff(of)
            lead = (data & 0xC0) != 0x80
            inside = np.concatenate([[0], np.cumsum(lead)])
            chars = np.bincount(rank_within(of, len(starts)), weights=inside[ends] - inside[starts], minlength=n).astype(np.int64)
            symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets])
            lines = np.asarray([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            failed = (total < 50) | (100 * repeat > 50 * total)
            found = {"n_words": total, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat, "repeat_covered": cover, "longest_repeat": most}
            found = {c: pa.array(v.astype(np.int64)) for c, v in found.items()}
            found |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (cover <= max_covered * total) & (most <= max_longest))}
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(found[c] for c in names)], out_names)

    return map_arrow(docs.select(*keep) if "text" in keep else docs.select(*keep, "text"), run, schema)


def filter_repetitive(docs: DataFrame) -> DataFrame:
    """The rows of *docs* that assess() keeps, with the columns that they had."""
    (kept,) = fresh(docs, "kept")
    return assess(docs, names={"kept": kept}).where(F.col(kept)).select(*docs.columns)
