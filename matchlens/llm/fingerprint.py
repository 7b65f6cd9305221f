"""Order MinHash fingerprints of texts (operator 7), in DataFrame functions only.

A text's k-mers are its runs of ``K`` words, numbered by occurrence, so that repeats
count.  Each of ``SEEDS`` seeds has an order of its own of all numbered k-mers, and the two
least of the text are the seed's minimal k-mers.  They are put back into the order of the
text and hashed as a tuple: the seed's signature agrees between two texts only if they share
the minimal k-mers and their order, which follows edit distance where plain MinHash follows
sets.  (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019.)

The orders come from ``CIRCLES`` hashes.  A hash puts every numbered k-mer at a point of a
circle, and a seed's order begins at a point of its own and goes round, so that one sort by
circle serves all of its seeds: the two least k-mers are the next two points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import fresh

K = 3
#: Selections of two k-mers, each in an order of its own, and the hashes that they come from.
SEEDS, CIRCLES = 64, 4
#: Bits of a signature.
SIGNATURE = (1 << 24) - 1
#: Low bits of a packed value hold the position (a text has fewer words than that), the rest the hash.
POSITION_BITS = 30
POSITION = (1 << POSITION_BITS) - 1
#: Documents that are put in order together, and the most such buckets.
BUCKET_ROWS, MOST_BUCKETS = 2_000, 20_000

_LEAST = -(1 << 63)
_SPACES = " \t\n\x0b\x0c\r"


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _packed(h: Column, position: Column) -> Column:
    return h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(POSITION)))


def starting_point(seed: int) -> int:
    """Where a seed's order begins: evenly spaced on its circle, of which it is one of SEEDS / CIRCLES."""
    each = SEEDS // CIRCLES
    return _LEAST + (seed % each) * ((1 << 64) // each)


def _with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """*df* with the array column *name*: (seed, signature) of each seed, packed into longs; empty without words."""
    hashes, packed, firsts, nth, *circles = fresh(df, "_hashes", "_packed", "_firsts", "_nth", *(f"_circle{i}" for i in range(CIRCLES)))
    trimmed = F.btrim(F.col(text), F.lit(_SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    # Columns that a lambda reads are named twice or more, or the optimizer would compute them for every element.
    count = F.when(F.size(hashes) > 0, F.greatest(F.size(hashes) - (K - 1), F.lit(1))).otherwise(0)
    kmers = F.transform(F.col(hashes), lambda w, i: _packed(F.xxhash64(w, *(F.get(F.col(hashes), i + j) for j in range(1, K))), i))
    df = df.withColumn(packed, F.sort_array(F.slice(kmers, F.lit(1), count)))

    def begins(i: Column) -> Column:
        own, before = (F.shiftright(F.get(F.col(packed), at), POSITION_BITS) for at in (i, i - 1))
        return (i == 0) | (own != before)

    # Equal k-mers are neighbours now, in the order of the text: runs number them.
    df = df.withColumn(firsts, F.filter(_upto(F.size(packed)), begins))
    runs = F.transform(F.col(firsts), lambda at, i: F.sequence(F.lit(1), F.coalesce(F.get(F.col(firsts), i + 1), F.size(packed)) - at))
    df = df.withColumn(nth, F.when(F.size(firsts) < F.size(packed), F.flatten(runs)))

    def point(r: int):
        def of(x: Column, i: Column) -> Column:
            own = F.when(F.col(nth).isNotNull(), F.get(F.col(nth), i)).otherwise(1)
            return _packed(F.xxhash64(F.shiftright(x, POSITION_BITS), own, F.lit(r)), x)

        return of

    for r, circle in enumerate(circles):
        df = df.withColumn(circle, F.sort_array(F.transform(F.col(packed), point(r))))
    n = F.size(packed)
    steps, *places = fresh(df, "_steps", *(f"_places{r}" for r in range(CIRCLES)))
    df = df.withColumn(steps, F.filter(F.array(*(F.lit(1 << b) for b in range(POSITION_BITS - 1, -1, -1))), lambda x: x <= n))
    each = SEEDS // CIRCLES
    starts = F.array(*(F.lit(starting_point(k)) for k in range(each)))

    def place(circle: str):
        """How many points lie before the start of an order, by binary search."""

        def go(start: Column):
            return lambda below, step: F.when((below + step <= n) & (F.get(F.col(circle), below + step - 1) < start), below + step).otherwise(below)

        return lambda start: F.aggregate(F.col(steps), F.lit(0), go(start))

    for circle, at in zip(circles, places, strict=True):
        df = df.withColumn(at, F.when(n > 0, F.transform(starts, place(circle))).otherwise(F.array().cast("array<int>")))

    def signature(circle: str, r: int):
        def of(at: Column, k: Column) -> Column:
            a, b = F.get(F.col(circle), F.pmod(at, n)), F.get(F.col(circle), F.pmod(at + 1, n))
            x, y = F.shiftright(a, POSITION_BITS), F.shiftright(b, POSITION_BITS)
            inorder = a.bitwiseAND(F.lit(POSITION)) < b.bitwiseAND(F.lit(POSITION))
            pair = F.when(inorder, F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))
            return F.shiftleft((k + r * each).cast("long"), 24).bitwiseOR(pair.bitwiseAND(F.lit(SIGNATURE)))

        return of

    found = F.concat(*(F.transform(F.col(at), signature(circle, r)) for r, (circle, at) in enumerate(zip(circles, places, strict=True))))
    return df.withColumn(name, found).drop(hashes, packed, firsts, nth, steps, *circles, *places)


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """*df* with an array column *name* for the string column *text* (null: as empty).

    Texts without words have an empty fingerprint, a text of one k-mer has it twice in each
    pair, and equal texts have equal fingerprints.  Of texts of 2**30 words or more,
    positions repeat."""
    (own,) = fresh(df, "_text")
    return _with_fingerprint(df.withColumn(own, F.coalesce(F.col(text), F.lit(""))), own, name).drop(own)


def likeness(a: str, b: str) -> Column:
    """Part of the seeds used by either fingerprint whose signatures agree (1 if both are empty)."""
    used = F.size(F.array_union(*(F.transform(F.col(x), lambda v: F.shiftright(v, 24)) for x in (a, b))))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.col(a), F.col(b))) / used)


def as_text(name: str) -> Column:
    """Eight hexadecimal digits for each seed: two name it, six are its signature."""
    return F.array_join(F.transform(F.col(name), lambda v: F.lpad(F.hex(v), 8, "0")), "")


def _bucket(splits: list[int], at: Column) -> Column:
    """How many of the ascending *splits* are at most *at*, by binary search."""
    if not splits:
        return F.lit(0)
    values, n = F.array(*map(F.lit, splits)), len(splits)
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]

    def step(found: Column, width: Column) -> Column:
        to = found + width
        return F.when((to <= n) & (F.get(values, to - 1) <= at), to).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(df: DataFrame, columns: list[str], add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """*df* with struct ``_next`` of *columns* of the next row by descending doc_id.

    After the last row comes the first; rows with the same doc_id follow each other in
    the order of their texts, null doc_ids are last.  Rows are dealt to buckets of doc_id
    ranges; each bucket also gets a copy of the row that follows it, so that no window
    spans more than a bucket (rows that share a doc_id, or have none, are of one bucket).
    *add* gives the rows further columns before they are put in order.
    """
    at = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    n = df.agg(F.count("*")).first()[0]
    buckets = min(max(n // BUCKET_ROWS, 1), MOST_BUCKETS)
    splits: list[int] = []
    if buckets > 1:
        found = df.agg(F.percentile_approx(at, [i / buckets for i in range(1, buckets)], F.lit(max(10_000, 4 * buckets)))).first()[0]
        splits = sorted(set(found))
    df = df.withColumns({"_at": at, "_bucket": _bucket(splits, at)})
    # Bounded by MOST_BUCKETS rows: the greatest key of each bucket follows the bucket above.
    tops = df.groupBy("_bucket").agg(F.max("_at").alias("_top"))
    order = Window.orderBy("_bucket")
    above = F.coalesce(F.lead("_bucket").over(order), F.first("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select(F.col("_top").alias("_at"), above.alias("_for"))
    extra = df.join(F.broadcast(tops.withColumnRenamed("_for", "_to")), "_at").withColumn("_bucket", F.col("_to")).drop("_to")
    rows = add(df.withColumn("_extra", F.lit(False)).unionByName(extra.withColumn("_extra", F.lit(True))))
    own = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_at"), "text")
    return rows.withColumn("_next", F.lead(F.struct(*columns)).over(own)).where(~F.col("_extra")).drop("_extra", "_at", "_bucket")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of *docs* (doc_id, text) and of its edited form.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first
    as many (or all) of the next document's by descending doc_id (after the last: the
    first).  Null counts as empty.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (likenesses, 0 to 1).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs, ["text", "_own"], lambda df: _with_fingerprint(df, "text", "_own"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("_edited_text"), "_own", F.col("_next._own").alias("_other"))
    rows = _with_fingerprint(rows, "_edited_text", "_edited")
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited_text", 256).alias("edited_sha256"), as_text("_own").alias("fingerprint"), as_text("_edited").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"), likeness("_own", "_other").alias("near_next"),
    )
