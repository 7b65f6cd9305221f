"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 2).

Training counts every n-gram of every labelled text into ``2 ** bits`` hashed columns per
language; the counts are summed by Spark, and the log-probability matrix (languages x
columns of 32-bit floats, of bounded size) is broadcast.  Scoring gathers
matrix rows for a batch of texts at once and sums them by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import SLICE_BYTES, fresh, map_arrow, mix, slices, stored

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 15
#: Cells of the matrix that is broadcast (64 MB), unless there are more languages than that.
MATRIX_CELLS = 1 << 24
#: Languages whose counts a task holds; cells of the matrix gathered at once.
HELD_LANGUAGES, GATHERED = 64, 1 << 21
#: n-grams counted or scored at once.
PIECE = 1 << 18


def _code_points(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a slice, and the n + 1 offsets of its documents in them."""
    raw = rows.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _has_letter(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = rows.tobytes()
    return np.asarray([any(map(str.isalpha, raw[a:b].decode("utf-8", "replace"))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)


def _grams(points: np.ndarray, doc: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Column of every n-gram that lies in one document, and that document."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
    whole = doc[:n] == doc[order - 1 :]
    return (mix(h) >> np.uint64(64 - bits)).astype(np.int64)[whole], doc[:n][whole]


def _pieces(points: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(points), PIECE):
        for order in ORDERS:
            to = at + PIECE + order - 1
            yield _grams(points[at:to], doc[at:to], order, bits)


def train(labelled: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """The languages of *labelled* (text, lang; a null lang teaches nothing) and the
    log-probability matrix, one row per column of hashed n-grams.  All rows are used, and
    every label is learned; a matrix of many labels has fewer, i.e. wider, columns, so that
    what is broadcast stays within MATRIX_CELLS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for rows, data, ends in slices(batches):
            langs = rows.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {x: i for i, x in enumerate(names)}
            of = np.asarray([index[x] for x in langs])
            points, offsets = _code_points(data, ends)
            sums: dict[int, np.ndarray] = {}
            for column, doc in _pieces(points, offsets, bits):
                lang = of[doc]
                for i in np.unique(lang).tolist():
                    sums[i] = sums.get(i, 0) + np.bincount(column[lang == i], minlength=1 << bits)
            for i, x in enumerate(names):
                found[x] = found.get(x, 0) + sums.get(i, np.zeros(1 << bits, np.int64))
                docs[x] = docs.get(x, 0) + int((of == i).sum())
            if len(found) > HELD_LANGUAGES:
                yield from counted_rows(found, docs)
                found, docs = {}, {}
        yield from counted_rows(found, docs)

    def counted_rows(found: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for x, sums in found.items():
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(sums[used], docs[x]))], ["lang", "column", "n"]
            )

    counted = map_arrow(labelled.where(F.col("lang").isNotNull()).select("lang", "text"), count, "lang string, column long, n long")
    counted = stored(counted.groupBy("lang", "column").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counted.where("column = -1").select("lang").collect())
    narrow = bits
    while narrow > 0 and len(languages) << narrow > MATRIX_CELLS:
        narrow -= 1
    if narrow < bits:
        # The columns of fewer bits are sums of neighbours.
        column = F.when(F.col("column") < 0, F.col("column")).otherwise(F.shiftright("column", bits - narrow))
        counted = counted.groupBy("lang", column.alias("column")).agg(F.sum("n").alias("n"))
    rows = counted.select("lang", "column", "n").toArrow()
    row = np.searchsorted(np.asarray(languages, object), np.asarray(rows.column("lang").to_pylist(), object)) if languages else np.zeros(0, np.int64)
    column, n = rows.column("column").to_numpy(), rows.column("n").to_numpy()
    counts, docs = np.zeros((1 << narrow, len(languages))), np.zeros(len(languages))
    own = column < 0
    docs[row[own]] = n[own]
    counts[column[~own], row[~own]] = n[~own]
    prob = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << narrow)))
    prior = np.log((docs + 1) / (docs.sum() + len(languages)))
    return languages, np.vstack([prob, prior]).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, names: tuple[str, str] = ("lang_pred", "score"), columns: list[str] | None = None) -> DataFrame:
    """*docs* with the predicted language and its posterior probability (0 to 1) as columns *names*.

    The language is ``und`` and the probability 0 where the text is null, has no letter, or
    nothing was learned.  Ties go to the language that sorts first.  The *columns* of *docs*
    (default: all) are passed on and never used; those called as *names* are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast((languages, matrix))
    bits = (len(matrix) - 1).bit_length() - 1
    taken = {x.lower() for x in names}
    keep = [c for c in (docs.columns if columns is None else columns) if c.lower() not in taken]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = known.value
        width = max(len(langs), 1)
        for rows, data, ends in slices(batches, most=max(1 << 14, min(SLICE_BYTES, (1 << 28) // width))):
            letters = _has_letter(data, ends)
            points, offsets = _code_points(data, ends)
            sums = np.zeros((rows.num_rows, len(langs)))
            if langs:
                step = max(1, GATHERED // width)
                for column, doc in _pieces(points, offsets, bits):
                    for lo in range(0, len(doc), step):
                        d = doc[lo : lo + step]
                        at = np.flatnonzero(np.diff(d, prepend=-1))
                        sums[d[at]] += np.add.reduceat(table[column[lo : lo + step]], at, axis=0, dtype=np.float64)
                sums += table[-1]
                best = sums.argmax(1)
                with np.errstate(under="ignore"):
                    sure = 1 / np.exp(sums - sums[np.arange(len(best)), best, None]).sum(1)
                out = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                sure = np.where(letters, sure, 0.0)
            else:
                out, sure = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(out, pa.string()), pa.array(sure)], [*keep, *names])

    return map_arrow(docs.select(*keep) if "text" in keep else docs.select(*keep, "text"), score, schema)


def held_out(of: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves *rest* when divided by *of* (null doc_id: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == rest


def identify(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    learned = train(docs.where(~held_out(4, 2)), bits)
    return predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), *learned, columns=["doc_id", "held_out"])


def accept(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of *docs* that the model rejects not: texts that are null or have no letter go.

    Where no row has a language nothing is learned, and every text with a letter stays.
    All columns stay as they are, whatever their names.
    """
    languages, matrix = train(docs.where(~held_out(4, 2)), bits)
    if not languages:
        languages, matrix = ["any"], np.zeros(((1 << bits) + 1, 1), np.float32)
    names = fresh(docs, "lang_pred", "score")
    return predict(docs, languages, matrix, tuple(names)).where(F.col(names[0]) != UNKNOWN).select(*docs.columns)
