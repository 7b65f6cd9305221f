"""Language-model scoring by online logistic context mixing (operator 1).

A text is its words (A-Z lower-cased) and one end.  Frequent words have Huffman codes;
other words are an escape and then their bytes, which have codes of their own.  Every
binary decision of a code is predicted from hashed contexts:

* for words: the last very frequent word before (which tells language and style), the
  word before (its last two bytes if it is rare), and the punctuation before;
* for bytes of a spelled word: the three, the four, and the two bytes before.

A predictor's slot holds how often the decision was 0 and 1 in the training texts.  The
logits are mixed with weights that a gate (how much two of the slots have seen) selects.
The weights of every gate are learned from all training texts: each of two halves of them
meets the slots of the other half (the second is counted as it does), and Newton steps fit
the weights to the sums of both by gate and cell of logits.  Along a document each gate's weights are refined: before every chunk of decisions
they take one more, damped step by all earlier decisions of that document.

Counts, codes and slots are distributed sums over every training text.  What is broadcast
(words with codes, slots) grows as the square root of the training tokens, as vocabularies
do; all other words get their counts by a join.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import _BASE, _LOWER, _WS, find_words, hash_words, map_arrow, mix, rank_within, signed, slices, stored
from matchlens.llm.langid import held_out

#: Training tokens up to which the model has its least size; of four times as many it has twice that.
LEAST_TOKENS = 1 << 24
#: Least number of words with codes, least slots of the three predictors as powers of two (two
#: bytes each when broadcast), and least ranks below which a word is a context itself (as the
#: last frequent word, as the word before).
CODED_WORDS, SLOT_BITS, RECENT, BEFORE = 1 << 17, (21, 21, 18), 256, 2048
#: Slots that are summed together, as a power of two.
CHUNK_BITS = 16
#: Bytes of text handled at once; a longer document goes through in parts that end with a word.
PIECE_BYTES = 1 << 17
#: Consecutive decisions of a code whose slots by one context lie together, in 2**TOGETHER places.
TOGETHER = 4
#: Decisions between two refinements of a document's weights, as a power of two, and the weight of what was learned against them.
CHUNK_SHIFT, DAMPING = 7, 5000.0
STEEPEST = 8.0
#: Newton steps for the gates' weights, and how firmly they hold to the weights they start from.
WEIGHT_STEPS, WEIGHT_PRIOR = 3, 50.0
#: Logits are summed up in so many cells of equal width each.
LOGIT_CELLS = 33
START = (0.4, 0.5, 0.15)
GATES = 16

_KIND_WORD, _KIND_BYTE, _KIND_DOCS = 0, 1, 2


@dataclass
class Codes:
    """The frequent words by ascending hash with count, rank and code (length 0: spelled),
    and codes of end, escape, and the bytes (256 ends a word)."""

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    code: np.ndarray
    length: np.ndarray
    end: tuple[int, int]
    escape: tuple[int, int]
    byte_code: np.ndarray
    byte_length: np.ndarray
    ends: int
    slot_bits: tuple[int, int, int]
    recent: int
    before: int

    @cached_property
    def buckets(self) -> tuple[int, np.ndarray]:
        """A shift that leaves the first bits of a hash, and for each such value where its hashes begin."""
        bits = max(1, len(self.hashes).bit_length())
        shift = 64 - bits
        return shift, np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift))

    @cached_property
    def entries(self) -> np.ndarray:
        """For each word what a token of it needs: code, length (6 bits), and whether it is a context as the word before and as the last frequent word."""
        return self.code << 8 | self.length.astype(np.int64) << 2 | (self.ranks < self.before) << 1 | (self.ranks < self.recent)


def doublings(tokens: int) -> int:
    """How often the model's least size is doubled for so many training tokens."""
    return max(0, (tokens // LEAST_TOKENS).bit_length() - 1) // 2


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical Huffman codes and their lengths for positive counts (ties by index)."""
    n = len(counts)
    if n == 1:
        return np.zeros(1, np.int64), np.ones(1, np.int64)
    by_count = np.argsort(counts, kind="stable")
    leaves, merged = array("q", counts[by_count].astype(np.int64).tobytes()), array("q")
    parent = array("q", bytes(8 * (2 * n - 1)))
    i = j = 0
    # Leaves and merged nodes both ascend: the least is the head of one of them.
    for k in range(n - 1):
        total = 0
        for _ in range(2):
            if i < n and (j >= k or leaves[i] <= merged[j]):
                total += leaves[i]
                parent[i] = n + k
                i += 1
            else:
                total += merged[j]
                parent[n + j] = n + k
                j += 1
        merged.append(total)
    depth = array("q", bytes(8 * (2 * n - 1)))
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    length = np.empty(n, np.int64)
    length[by_count] = np.frombuffer(depth, np.int64)[:n]
    order = np.lexsort((np.arange(n), length))
    sizes = np.bincount(length)
    first = np.zeros(len(sizes), np.int64)
    for k in range(1, len(sizes)):
        first[k] = (first[k - 1] + sizes[k - 1]) << 1
    out = np.empty(n, np.int64)
    out[order] = first[length[order]] + np.arange(n) - (np.cumsum(sizes) - sizes)[length[order]]
    return out, length


def make_codes(hashes: np.ndarray, counts: np.ndarray, others: int, byte_counts: np.ndarray, docs: int) -> Codes:
    """*others*: training words that are not among *hashes*, which counts for the escape."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    by_count = np.lexsort((hashes, -counts))
    ranks = np.empty(len(hashes), np.int64)
    ranks[by_count] = np.arange(len(hashes))
    # Words met once teach the escape and the spelling instead.
    coded = by_count[: int((counts > 1).sum())]
    tokens = others + int(counts.sum()) + docs
    escaped = others + int(counts.sum() - counts[coded].sum())
    words, lengths = huffman(np.concatenate([counts[coded], [docs + 1, escaped + 1]]))
    code, length = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int8)
    code[coded], length[coded] = words[:-2], lengths[:-2]
    own, own_length = huffman(np.append(byte_counts, max(escaped, 1)) + 1)
    more = doublings(tokens)
    end, escape = ((int(words[i]), int(lengths[i])) for i in (-2, -1))
    return Codes(hashes, counts, ranks, code, length, end, escape, own, own_length, docs, tuple(b + more for b in SLOT_BITS), RECENT << more, BEFORE << more)


@dataclass
class Carry:
    """What a part of a long document leaves to the next: contexts, and its gates' sums."""

    recent: np.uint64
    name: np.uint64
    mark: np.uint64
    sums: np.ndarray


@dataclass
class Piece:
    """The decisions of a piece of documents, or of a part of a long one.

    They lie by their depth in a code, and symbols by falling length of their codes: those
    that reach a depth are the first so many (*reach*), and nothing is repeated or gathered."""

    bits: np.ndarray
    hits: list[np.ndarray]
    begin: np.ndarray
    doc: np.ndarray
    reach: list[int]
    of: np.ndarray
    carry: Carry | None
    words: np.ndarray | None = None
    known: np.ndarray | None = None
    counted: np.ndarray | None = None
    rare: np.ndarray | None = None
    rare_of: np.ndarray | None = None
    n_bytes: np.ndarray | None = None

    def by_depth(self, first: np.ndarray) -> np.ndarray:
        """For each decision the number of its symbol's first decision, given by symbols, plus its depth."""
        out = np.empty(len(self.bits), first.dtype)
        lo = 0
        for d, m in enumerate(self.reach):
            np.add(first[:m], d, out=out[lo : lo + m])
            lo += m
        return out

    def _ordered(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.by_depth(self.begin)] = values
        return out

    @property
    def y(self) -> np.ndarray:
        """What was decided, in the order of the text."""
        return self._ordered(self.bits)

    @property
    def slots(self) -> list[np.ndarray]:
        """The slots that predict it, in the order of the text."""
        return [self._ordered(s) for s in self.hits]


#: What names a rare word: by its last byte and 256 times the one before.
_MARKS = mix(np.arange(4, dtype=np.uint64) + np.uint64(11))
_TAILS = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 20))


def _lookup(c: Codes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(c.hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    shift, begin = c.buckets
    at = np.take(begin, (h >> np.uint64(shift)).astype(np.intp))
    last = len(c.hashes) - 1
    np.minimum(at, last, out=at)
    there = np.take(c.hashes, at)
    # The few that lie behind others of their bucket go on.
    late = np.flatnonzero(there < h)
    while len(late):
        late = late[at[late] < last]
        at[late] += 1
        there[late] = c.hashes[at[late]]
        late = late[there[late] < h[late]]
    return at, there == h


def decisions(c: Codes, data: np.ndarray, offsets: np.ndarray, carry: Carry | None = None, last: bool = True, tally: bool = True) -> Piece:
    """The binary decisions of whole documents and the slots that predict them.

    Of a part of one document *carry* is what the part before left, and *last* says whether
    its end belongs to it.  Without *tally* the documents' words are not counted."""
    starts, ends, of = find_words(data, offsets)
    h = hash_words(data, starts, ends, lower=True)
    n_docs, n_words = len(offsets) - 1, len(h)
    at, found = _lookup(c, h)
    doc = rank_within(of, n_words)
    # Tokens: every document's words, then its end.
    token_of = of + np.arange(n_docs + 1) * last
    word_at = np.arange(n_words) + doc * last
    tokens = n_words + n_docs * last
    entry = np.take(c.entries, at) if len(c.hashes) else np.zeros(n_words, np.int64)
    entry[~found] = 0
    size = entry >> 2 & 63
    coded = size > 0
    code, length = np.full(tokens, c.end[0]), np.full(tokens, c.end[1])
    code[word_at] = np.where(coded, entry >> 8, c.escape[0])
    length[word_at] = np.where(coded, size, c.escape[1])
    # Contexts of tokens.
    frequent = np.zeros(tokens, bool)
    frequent[word_at] = entry & 1 > 0
    name = np.zeros(tokens, np.uint64)
    low = data + ((data - np.uint8(65) < 26) * np.uint8(32)) if len(data) else np.zeros(1, np.uint8)
    final_byte = low[ends - 1]
    tail = np.take(_TAILS, np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.intp) * 256 + final_byte)
    name[word_at] = np.where(entry & 2 > 0, h, tail)
    mark = np.zeros(tokens, np.uint64)
    mark[word_at] = np.where(final_byte == ord("."), 1, np.where(final_byte == ord(","), 2, 3))
    first = np.repeat(token_of[:-1], np.diff(token_of))
    position = np.arange(tokens)
    recent = np.maximum.accumulate(np.where(frequent, position, -1))
    recent = np.concatenate([[-1], recent[:-1]]) if tokens else recent
    whole = np.zeros(tokens, np.uint64)
    whole[word_at] = h
    a = np.where(recent >= first, whole[np.maximum(recent, 0)] if tokens else whole, carry.recent if carry else np.uint64(0))
    head = position == first
    b, p = np.roll(name, 1), np.roll(mark, 1)
    b[head], p[head] = (carry.name, carry.mark) if carry else (0, 0)
    left_over = None
    if not last or carry:
        seen = np.flatnonzero(frequent)
        before = carry or Carry(np.uint64(0), np.uint64(0), np.uint64(0), np.zeros((3, 2 * GATES)))
        left_over = Carry(whole[seen[-1]] if len(seen) else before.recent, name[-1] if tokens else before.name, mark[-1] if tokens else before.mark, before.sums)
    # Symbols: a token's own, then the bytes of a spelled word and their end.
    spell = np.flatnonzero(~coded)
    more = np.zeros(tokens, np.int64)
    count = (ends - starts)[spell] + 1
    more[word_at[spell]] = count
    symbol_of = np.concatenate([[0], np.cumsum(more + 1)])
    n = int(symbol_of[-1])
    own = symbol_of[:-1]
    codes, lengths = np.empty(n, np.int64), np.empty(n, np.int64)
    contexts = [np.empty(n, np.uint32) for _ in range(3)]
    codes[own], lengths[own] = code, length
    for to, x in zip(contexts, (mix(a + np.uint64(11)), mix(b + np.uint64(11)), np.take(_MARKS, p.astype(np.intp))), strict=True):
        to[own] = x >> np.uint64(32)
    if len(spell):
        total = np.cumsum(count)
        nth = np.arange(total[-1]) - np.repeat(total - count, count)
        source = np.repeat(starts[spell], count) + nth
        letter = np.take(low, source, mode="clip").astype(np.int64)
        letter[total - 1] = 256
        place = np.repeat(own[word_at[spell]] + 1, count) + nth
        codes[place], lengths[place] = c.byte_code[letter], c.byte_length[letter]
        before, v = [], (letter + 1).astype(np.uint64)
        for _ in range(4):
            # The letter before, of a word's first none.
            v = np.concatenate([v[:1], v[:-1]])
            v[total - count] = 0
            before.append(v)
        two = before[0] + np.uint64(1 << 40) + (before[1] << np.uint64(9))
        three = two + (before[2] << np.uint64(18))
        four = three + (before[3] << np.uint64(27))
        for to, x in zip(contexts, (three, four, two), strict=True):
            to[place] = mix(x) >> np.uint64(32)
    # Decisions: the bits of each symbol's code; a node is the code's prefix with a leading one.
    step = np.cumsum(lengths)
    longest = int(lengths.max(initial=0))
    order = np.argsort((longest - lengths).astype(np.uint8), kind="stable")
    kind = np.uint32 if longest < 32 else np.uint64
    tagged = ((codes | (np.int64(1) << lengths)) << (longest - lengths)).astype(kind)[order]
    contexts = [x[order] for x in contexts]
    reach = (n - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]).tolist()
    bits, hits = np.empty(sum(reach), np.uint8), [np.empty(sum(reach), np.uint32) for _ in range(3)]
    lo = 0
    for d, m in enumerate(reach):
        tag = tagged[:m]
        bits[lo : lo + m] = (tag >> kind(longest - 1 - d)) & kind(1)
        node = (tag >> kind(longest - d)).astype(np.uint32, copy=False)
        nth = d % TOGETHER
        if not nth:
            node *= np.uint32(0x9E3779B1)
            near = [((x[:m] + node) * np.uint32(0x85EBCA77)) >> np.uint32(32 - width) for x, width in zip(contexts, c.slot_bits, strict=True)]
            node = np.uint32(1)
        else:
            node &= np.uint32((1 << nth) - 1)
            node |= np.uint32(1 << nth)
        for x, to in zip(near, hits, strict=True):
            np.bitwise_xor(x[:m], node, out=to[lo : lo + m])
        lo += m
    decisions_of = np.concatenate([[0], step])[symbol_of[token_of]]
    doc_of = np.repeat(np.arange(n_docs), np.diff(symbol_of[token_of]))
    piece = Piece(bits, hits, (step - lengths)[order], doc_of[order], reach, decisions_of, left_over)
    if tally:
        rare = ~found
        logs = np.where(found, np.log10((c.counts[at] if len(c.hashes) else np.zeros(n_words)) + 1.0), 0.0)
        piece.words, piece.known, piece.counted = np.diff(of), np.bincount(doc[found], minlength=n_docs), np.bincount(doc, weights=logs, minlength=n_docs)
        piece.rare, piece.rare_of = h[rare], doc[rare]
        piece.n_bytes = np.bincount(doc, weights=ends - starts + 1, minlength=n_docs) + last
    return piece


#: A count in one byte: exact up to 64, then in steps of an eighth of a doubling.
_COUNTS = np.concatenate([np.arange(65), np.rint(64 * 2.0 ** (np.arange(1, 192) / 8))])


def pack_slots(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A slot in 16 bits: both counts, a byte each."""
    byte = [(np.searchsorted(_COUNTS, n, "right") - 1).astype(np.uint16) for n in (zeros, ones)]
    return byte[0] | (byte[1] << np.uint16(8))


def _slot_tables(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit, and how much the slot has seen (none, under 4, under 32, more)."""
    seen = zeros + ones
    logit = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -STEEPEST, STEEPEST).astype(np.float32)
    return logit, ((seen > 0).astype(np.uint8) + (seen >= 4) + (seen >= 32)).astype(np.uint8)


_ZEROS, _ONES = _COUNTS[np.arange(1 << 16) & 255], _COUNTS[np.arange(1 << 16) >> 8]
_LOGITS, _SEEN = _slot_tables(_ZEROS, _ONES)


#: What scoring needs of a packed slot in 16 bits: STEPS times its logit, rounded so that the last two bits are how much it has seen.
STEPS = 4092
_VALUES = (np.rint((_LOGITS.astype(np.float64) * STEPS - _SEEN) / 4) * 4 + _SEEN).astype(np.int16)
#: What learning weights needs, in 8 bits: four times the cell of its logit, and how much it has seen.
_CELLS = (np.rint((_LOGITS + STEEPEST) * ((LOGIT_CELLS - 1) / (2 * STEEPEST))).astype(np.uint8) << 2) | _SEEN


def slot_values(slots: list[np.ndarray]) -> list[np.ndarray]:
    return [np.take(_VALUES, t) for t in slots]


def mixed_log10(piece: Piece, slots: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """log10 probability of each document by packed slots."""
    return mixed_values_log10(piece, slot_values(slots), weights)


def mixed_values_log10(piece: Piece, values: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """log10 probability of each document: the online pass over its decisions.

    Gradients and curvatures are those at the learned weights, so a gate's weights before
    a chunk follow from sums over the document's chunks before it."""
    n = len(piece.of) - 1
    if not len(piece.bits):
        return np.zeros(n)
    found = [np.take(t, s.astype(np.intp), mode="clip") for t, s in zip(values, piece.hits, strict=True)]
    # A row for each chunk of a document, in it a cell for each gate.
    chunks = -(-np.diff(piece.of) >> CHUNK_SHIFT)
    first = np.concatenate([[0], np.cumsum(chunks)])
    rows = int(first[-1])
    cell = piece.by_depth(((first[:-1] << CHUNK_SHIFT) - piece.of[:-1])[piece.doc] + piece.begin)
    cell >>= CHUNK_SHIFT
    cell *= GATES
    gate = (((found[0] & 3) << 2) | (found[1] & 3)).astype(np.intp)
    cell += gate
    x = [v.astype(np.float32) for v in found]
    learned = (weights / STEPS).astype(np.float32)
    z = _weighted(x, [np.ascontiguousarray(learned[:, k]) for k in range(3)], gate)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    p = np.reciprocal(z, out=z)
    wrong = piece.bits - p
    p -= p * p
    size = [np.abs(v) for v in x]
    p *= size[0] + size[1] + size[2]
    head = np.repeat(first[:-1], chunks)
    tables, pair = [], np.empty(len(p), np.complex64)
    for k in range(3):
        # Gradient and curvature go as one number; a step by the row sums of the curvature never passes the optimum by much.
        np.multiply(wrong, x[k], out=pair.real)
        np.multiply(p, size[k], out=pair.imag)
        own = np.zeros(rows * GATES, np.complex64)
        np.add.at(own, cell, pair)
        own = own.view(np.float32).reshape(rows, 2 * GATES)
        before = np.cumsum(own, 0, dtype=np.float64)
        before -= own
        before -= np.take(before, head, 0)
        if piece.carry is not None:
            before += piece.carry.sums[k]
            piece.carry.sums[k] += own.sum(0, dtype=np.float64)
        shift = before[:, ::2] / (before[:, 1::2] + DAMPING * STEPS**2)
        shift += weights[:, k] / STEPS
        tables.append(shift.astype(np.float32).reshape(-1))
    z = _weighted(x, tables, cell)
    np.clip(z, -STEEPEST, STEEPEST, out=z)
    z *= np.float32(1) - np.float32(2) * piece.bits
    np.exp(z, out=z)
    z += 1
    np.log(z, out=z)
    lost, lo = np.zeros(len(piece.begin)), 0
    for m in piece.reach:
        lost[:m] += z[lo : lo + m]
        lo += m
    return -np.bincount(piece.doc, weights=lost, minlength=n) / np.log(10)


def _weighted(x: list[np.ndarray], tables: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Sum of the three inputs, each times its table's value at *at*."""
    z = np.take(tables[0], at, mode="clip")
    z *= x[0]
    for k in (1, 2):
        w = np.take(tables[k], at, mode="clip")
        w *= x[k]
        z += w
    return z


def _parts(batches: Iterator[pa.RecordBatch], codes: Codes, tally: bool = True) -> Iterator[tuple[pa.RecordBatch, Piece, bool]]:
    """Rows, their decisions, and whether that is all of them (else more parts of the one row follow)."""
    for rows, data, offsets in slices(batches, most=PIECE_BYTES):
        if rows.num_rows > 1 or len(data) <= 2 * PIECE_BYTES:
            yield rows, decisions(codes, data, offsets, tally=tally), True
            continue
        at, carry = 0, None
        while at < len(data) or carry is None:
            to = min(at + PIECE_BYTES, len(data))
            # A part ends behind a blank, if need be far behind.
            while to < len(data):
                blank = np.flatnonzero(_WS[data[to : to + PIECE_BYTES]])
                if len(blank):
                    to += int(blank[0]) + 1
                    break
                to = min(to + PIECE_BYTES, len(data))
            done = to >= len(data)
            piece = decisions(codes, data[at:to], np.asarray([0, to - at]), carry, done, tally)
            at, carry = to, piece.carry
            yield rows, piece, done
            if done:
                break


def _count(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of the training texts: words by hash, bytes, and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held, by_byte, n_docs = 0, np.zeros(256, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([n for _, n in found])).astype(np.int64)

        for rows, data, offsets in slices(batches):
            starts, ends, _ = find_words(data, offsets)
            found.append(np.unique(hash_words(data, starts, ends, lower=True), return_counts=True))
            by_byte += np.bincount(_LOWER[data], minlength=256)
            n_docs += rows.num_rows
            held += len(found[-1][0])
            if held > 2_000_000:
                found = [merged()]
                held = 0
        keys, n = merged() if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for lo in range(0, len(keys), 1 << 18):
            k = keys[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), _KIND_WORD, np.int32)), pa.array(signed(k)), pa.array(n[lo : lo + (1 << 18)])], ["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([_KIND_BYTE] * 256 + [_KIND_DOCS], pa.int32()), pa.array([*range(256), 0], pa.int64()), pa.array([*by_byte.tolist(), n_docs], pa.int64())], ["kind", "key", "n"])

    return map_arrow(docs, run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _gathered(docs: DataFrame, codes, known=None, count: bool = True) -> DataFrame:
    """What one pass over *docs* learns: with *count*, (chunk, seen) of their decisions for each
    task that met any; with *known* (cells of slots, and each cell's mean logit), (cell, n, x0,
    x1, x2) by gate and cell of the decisions' three logits, how many and the sums of each logit."""
    base = np.concatenate([[0], np.cumsum([1 << b for b in codes.value.slot_bits])])
    width, schema = 1 << CHUNK_BITS, pa.schema([("chunk", pa.int32()), ("seen", pa.binary()), ("cell", pa.int64()), *((c, pa.float64()) for c in ("n", "x0", "x1", "x2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * int(base[-1]) if count else 0, np.int32)
        met = np.zeros(1 << 23 if known else 0, np.int32)
        any_rows = False
        for _, piece, _ in _parts(batches, codes.value, tally=False):
            any_rows = True
            for k, s in enumerate(piece.hits if count else []):
                at = s.astype(np.intp)
                at <<= 1
                at += piece.bits
                np.add.at(seen[2 * base[k] : 2 * base[k + 1]], at, np.int32(1))
            if known:
                np.add.at(met, _cells_met(piece, known.value[0]), np.int32(1))
        for lo in range(0, int(base[-1]) if any_rows and count else 0, width):
            pairs = seen[2 * lo : 2 * (lo + width)].reshape(-1, 2)
            used = np.flatnonzero(pairs.any(1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([lo >> CHUNK_BITS], pa.int32()), pa.array([_squeezed(used, pairs[used])], pa.binary()), *(pa.nulls(1, f.type) for f in list(schema)[2:])], schema=schema)
        if known and any_rows:
            cell, *sums = _logit_sums(met, known.value[1])
            for lo in range(0, len(cell), 1 << 16):
                own = [pa.array(v[lo : lo + (1 << 16)]) for v in (cell, *sums)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(own[0]), f.type) for f in list(schema)[:2]), *own], schema=schema)

    return map_arrow(docs, run, "chunk int, seen binary, cell long, n double, x0 double, x1 double, x2 double")


def _cells_met(piece: Piece, cells: list[np.ndarray]) -> np.ndarray:
    """For each decision a number below 2**23: what it decided, then from above its three slots' cells (the third without how much it has seen)."""
    first, second, third = (np.take(t, s.astype(np.intp), mode="clip") for t, s in zip(cells, piece.hits, strict=True))
    out = first.astype(np.int32)
    out <<= 8
    out |= second
    out <<= 6
    out |= third >> np.uint8(2)
    out <<= 1
    out |= piece.bits
    return out.astype(np.intp)


def _logit_sums(met: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cell, n, x0, x1, x2) of the numbers of _cells_met(), signs turned towards what was decided; a decision counts with its cells' mean logits."""
    at = np.flatnonzero(met)
    n = met[at].astype(np.float64)
    first, second, third = at >> 15, (at >> 7) & 255, (at >> 1) & 63
    cell = (first & 3) << 2 | (second & 3)
    sign = 2.0 * (at & 1) - 1
    x = []
    for k, v in enumerate((first, second, third << 2)):
        cell = cell * LOGIT_CELLS + np.where(sign > 0, v >> 2, LOGIT_CELLS - 1 - (v >> 2))
        x.append(means[k][v] * sign * n)
    keys, back = np.unique(cell, return_inverse=True)
    return keys, *(np.bincount(back, weights=v, minlength=len(keys)) for v in (n, *x))


def slot_cells(slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The cells of packed slots, and for each of them the mean logit of its slots, by how often those were met."""
    cells, means = [np.take(_CELLS, t) for t in slots], np.zeros((3, 256))
    for k, (t, c) in enumerate(zip(slots, cells, strict=True)):
        # The third predictor's cells are told apart by their logits alone.
        c = c & np.uint8(252) if k == 2 else c
        met = np.bincount(c, weights=np.take(_ZEROS + _ONES, t), minlength=256)
        means[k] = np.bincount(c, weights=np.take((_ZEROS + _ONES) * _LOGITS, t), minlength=256) / np.maximum(met, 1)
    return cells, means


def _slots(tables: DataFrame, codes) -> list[np.ndarray]:
    """The packed slots from the (chunk, seen) of _gathered()."""
    base = np.concatenate([[0], np.cumsum([1 << b for b in codes.value.slot_bits])])
    width = 1 << CHUNK_BITS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((width, 2), np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pack_slots(sums[:, 0], sums[:, 1]).tobytes()], pa.binary())], ["chunk", "v"])

        for b in batches:
            for chunk, own in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if at is not None and chunk != at:
                    yield done()
                    sums[:] = 0
                at = chunk
                used, pairs = _unsqueezed(own)
                sums[used] += pairs
        if at is not None:
            yield done()

    every = np.zeros(int(base[-1]), np.uint16)
    for r in map_arrow(tables.repartition("chunk").sortWithinPartitions("chunk"), packed, "chunk int, v binary").collect():
        lo = r["chunk"] << CHUNK_BITS
        every[lo : lo + width] = np.frombuffer(r["v"], np.uint16)[: len(every) - lo]
    return [every[base[k] : base[k + 1]] for k in range(3)]


def _squeezed(used: np.ndarray, pairs: np.ndarray) -> bytes:
    """Ascending places below 2**16 and their counts: a byte for each distance and count, larger ones apart."""
    flat = np.concatenate([np.diff(used, prepend=0), pairs[:, 0], pairs[:, 1]])
    large = np.flatnonzero(flat > 254)
    own = np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[large].astype("<i4").tobytes()
    return np.asarray([len(used), len(own)], "<i4").tobytes() + pa.compress(own, codec="zstd", asbytes=True)


def _unsqueezed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(raw, "<i4", 2).tolist()
    own = pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True)
    flat = np.frombuffer(own, np.uint8, 3 * n).astype(np.int64)
    large = np.flatnonzero(flat == 255)
    flat[large] = np.frombuffer(own, "<i4", len(large), 3 * n)
    return np.cumsum(flat[:n]), flat[n:].reshape(2, n).T


def _learn_weights(sums: DataFrame) -> np.ndarray:
    """Weights of each gate: damped Newton steps on the log loss of all decisions in *sums* (at most GATES * LOGIT_CELLS**3 rows)."""
    found = sums.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "x0", "x1", "x2"))).toArrow()
    gate = found.column("cell").to_numpy() // LOGIT_CELLS**3
    n = found.column("n").to_numpy()
    # A cell's decisions count with its mean logits.
    x = np.stack([found.column(c).to_numpy() for c in ("x0", "x1", "x2")], 1) / np.maximum(n, 1)[:, None]
    start = np.tile(np.asarray(START), (GATES, 1))
    weights = start.copy()
    for _ in range(WEIGHT_STEPS):
        wrong = 1 / (1 + np.exp(np.clip((weights[gate] * x).sum(1), -STEEPEST, STEEPEST)))
        bend, slope = np.zeros((GATES, 3, 3)), np.zeros((GATES, 3))
        for i in range(3):
            slope[:, i] = np.bincount(gate, weights=n * wrong * x[:, i], minlength=GATES)
            for j in range(3):
                bend[:, i, j] = np.bincount(gate, weights=n * wrong * (1 - wrong) * x[:, i] * x[:, j], minlength=GATES)
        bend += WEIGHT_PRIOR * np.eye(3)
        slope -= WEIGHT_PRIOR * (weights - start)
        weights = np.clip(weights + np.linalg.solve(bend, slope[:, :, None])[:, :, 0], -4, 4)
    return weights


def score(docs: DataFrame, test: Column | None = None) -> DataFrame:
    """Scores of every row of *docs* (doc_id, text), learned from those where *test* is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (log10 probability of the text by the model) and bits_per_byte.  Null
    and empty texts are their end alone; without training texts every count is 0 and the
    slots say nothing.  Other columns are ignored; repeated rows get equal scores.  Long
    texts go through in parts; a word is never cut.
    """
    test = held_out(7, 2) if test is None else test
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), test.alias("held_out"), "text")
    train = rows.where("not held_out").select("text")
    counts = stored(_count(train))
    words = counts.where(F.col("kind") == _KIND_WORD)
    own = {(r["kind"], r["key"]): r["n"] for r in counts.where(F.col("kind") != _KIND_WORD).collect()}
    n_docs = own.get((_KIND_DOCS, 0), 0)
    # How many words have each count, up to one that few have; the most frequent words have codes.
    total, distinct, _ = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.max("n")).first()
    most = CODED_WORDS << doublings(int(total + n_docs))
    often = words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    least, held = 1 << 16, 0
    for r in often:
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    top = words.where(F.col("n") >= least).select("key", "n").toArrow()
    n = top.column("n").to_numpy().astype(np.int64)
    hashes = np.ascontiguousarray(top.column("key").to_numpy().astype(np.int64)).view(np.uint64)
    codes = sc.broadcast(make_codes(hashes, n, int(total - n.sum()), np.asarray([own.get((_KIND_BYTE, b), 0) for b in range(256)], np.int64), n_docs))
    # Each half's weights are taught with the slots of the other, which do not know its texts.
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    halves = [rows.where(~F.col("held_out") & (half == k)).select("text") for k in range(2)]
    gathered, known = [stored(_gathered(halves[0], codes))], None
    # The second half is counted as it meets the slots of the first.
    for own, count in ((halves[1], True), (halves[0], False)):
        known = sc.broadcast(slot_cells(_slots(gathered[-1].where("chunk is not null").select("chunk", "seen"), codes)))
        gathered.append(stored(_gathered(own, codes, known, count)))
        known.destroy()
    tables, sums = (
        a.unionByName(b) for a, b in (
            [g.where("chunk is not null").select("chunk", "seen") for g in gathered[:2]],
            [g.where("cell is not null").drop("chunk", "seen") for g in gathered[1:]],
        )
    )
    weights = sc.broadcast(_learn_weights(sums))
    values = sc.broadcast(slot_values(_slots(tables, codes)))
    all_tokens, vocabulary = int(total + n_docs), int(distinct + (n_docs > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        # Rows get numbers of their own: what is written below is read as it stands.
        row = TaskContext.get().partitionId() << 40
        for rows, piece, whole in _parts(batches, codes.value):
            found = (piece.words, piece.known, piece.counted, mixed_values_log10(piece, values.value, weights.value), piece.n_bytes)
            open_.append((found, piece.rare_of, piece.rare))
            if not whole:
                continue
            words, known, counted, logs, n_bytes = (np.sum([p[0][i] for p in open_], 0) for i in range(5))
            rare_of, rare = (np.concatenate([p[i] for p in open_]) for i in (1, 2))
            open_ = []
            # Each document's other words, with how often it has them.
            order = np.lexsort((rare, rare_of))
            rare_of, rare = rare_of[order], rare[order]
            new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1])])[: len(rare)])
            pairs = pa.StructArray.from_arrays([pa.array(signed(rare[new])), pa.array(np.diff(new, append=len(rare)))], ["key", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare_of[new], np.arange(rows.num_rows + 1)).astype(np.int32)), pairs)
            columns = [pa.array(np.arange(row, row + rows.num_rows)), pa.array(words + 1), pa.array(known.astype(np.int64)), pa.array(counted), pa.array(logs), pa.array(n_bytes.astype(np.int64)), lists]
            row += rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *columns], ["doc_id", "held_out", "_key", "n_tokens", "_known", "_logs", "score", "_bytes", "_rare"])

    schema = "doc_id long, held_out boolean, _key long, n_tokens long, _known long, _logs double, score double, _bytes long, _rare array<struct<key: long, times: long>>"
    scored = stored(map_arrow(rows, run, schema))
    # Words beyond the broadcast table: their counts by a join.
    seldom = scored.select("_key", F.inline("_rare")).join(words.where(F.col("n") < least).select("key", "n"), "key").groupBy("_key")
    seldom = seldom.agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more_logs"), F.sum("times").alias("_more_known"))
    out = scored.drop("_rare").join(seldom, "_key", "left")
    logs = F.col("_logs") + F.coalesce("_more_logs", F.lit(0.0)) + float(np.log10(n_docs + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more_known", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"), F.lit(all_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(all_tokens + vocabulary + 1))).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("_bytes")).alias("bits_per_byte"),
    )
