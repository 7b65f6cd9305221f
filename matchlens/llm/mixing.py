"""Mixing sources to target weights by entropy balancing (operator 10).

DataFrame operations only.  Each source gets a token target; the copy rates nearest to 1
in relative entropy that meet it are ``min(cap, exp(lambda * size / mean size))`` with one
dual variable per source, found by Newton steps whose sums are distributed aggregates
over the (source, size) histogram.  ``floor(rate + u)`` with a uniform u hashed from doc_id rounds
them; a search moves lambda until the rounded words are less than one copy below the
target, and single copies of documents that fit fill what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import WORD_PATTERN, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Most sources whose table of about 200 bytes each is broadcast.
BROADCAST_SOURCES = 50_000
#: Newton steps by job; relative error of a source's words at which they end.
STEPS_BY_JOB, TOLERANCE = 3, 1e-5
#: Values of lambda tried at once, and passes of that search.
TRIED, PASSES = 32, 4
#: Documents of one size, and sizes, that may fill what is left of a source.
FILL_DOCS, FILL_SIZES = 64, 20_000
#: Most of such documents (about 60 bytes each) that are broadcast.
BROADCAST_FILLED = 100_000


def words(col: str = "text") -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """The targets of *sources* (_null, _source, _total, _docs), one row each.

    Sharing by weight with a ceiling of ``cap`` times the size, the excess reshared, is
    ``min(ceiling, weight * level)``: in the order of ceiling / weight, the level is the
    first that what is left gives to the rest without passing the next ceiling.
    """
    order = Window.orderBy("_null", "_source")
    by_ceiling = Window.orderBy("_ratio", "_null", "_source")
    before, rest = by_ceiling.rowsBetween(Window.unboundedPreceding, -1), by_ceiling.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ceiling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    return (
        sources.withColumn("_weight", weight)
        .withColumn("_ceiling", F.lit(float(cap)) * F.col("_total"))
        .withColumn("_ratio", F.col("_ceiling") / F.col("_weight"))
        .withColumn("_try", (F.sum("_total").over(everything) - F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
        .withColumn("_level", F.min(F.when(F.col("_try") <= F.col("_ratio"), F.struct("_ratio", "_null", "_source", "_try"))).over(everything)["_try"])
        .select("_null", "_source", "_total", "_docs", F.least("_ceiling", F.col("_weight") * F.col("_level")).alias("_target"))
    )


def _rate(lam: Column, cap: float) -> Column:
    """Beyond the ceiling's exponent the exponential isn't needed, and could overflow."""
    x = lam * F.col("_size") / F.col("_mean")
    return F.when(x >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(x))


def _copies(lam: Column, cap: float) -> Column:
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    return F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.least(F.floor(_rate(lam, cap) + u), F.lit(int(cap)))).cast("int")


def _join(df: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    return df.join(F.broadcast(per_source) if small else per_source, ["_null", "_source"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of *docs* as one struct, out of reach of other names, beside what the mix needs."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return docs.select(row, "doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source"), words().alias("_size"))


def solve(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """The documents' (doc_id, _null, _source, _size), the table of sources with their
    solution, and whether that table is small enough to broadcast."""
    sizes = stored(_keyed(docs).select("doc_id", "_null", "_source", "_size"))
    histogram = stored(sizes.groupBy("_null", "_source", "_size").agg(F.count("*").alias("_n")))
    totals = histogram.groupBy("_null", "_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"), F.sum("_n").alias("_docs"))
    share = F.col("_target") / F.greatest(F.col("_total"), F.lit(1))
    # Between _lo and _hi some lambda meets the target: all rates are below the share, or at the ceiling.
    state = stored(
        targets(totals, weights, cap)
        .withColumn("_mean", F.greatest(F.col("_total") / F.col("_docs"), F.lit(1e-9)))
        .withColumn("_open", (F.col("_total") > 0) & (F.col("_target") < cap * F.col("_total") * (1 - 1e-12)))
        .withColumn("_lo", F.col("_mean") * (F.log(share) - 1.0))
        .withColumn("_hi", F.col("_mean") * math.log(cap) + 1.0)
        .withColumn("_lambda", F.when(F.col("_open"), F.log(share)).otherwise(F.col("_hi")))
        .withColumn("_off", F.lit(1.0))
    )
    small = state.count() <= BROADCAST_SOURCES
    while (state.agg(F.max("_off")).first()[0] or 0) > TOLERANCE:
        for _ in range(STEPS_BY_JOB):
            state = _newton(histogram, state, cap, small)
        state = stored(state)
    return sizes, _settle(sizes, state, cap, small), small


def _newton(histogram: DataFrame, state: DataFrame, cap: int, small: bool) -> DataFrame:
    """One Newton step of every source's dual, halving its interval where a step leaves it."""
    rate = _rate(F.col("_lambda"), cap)
    mass = F.col("_size") * F.col("_n") * rate
    sums = (
        _join(histogram, state.where("_open").select("_null", "_source", "_mean", "_lambda"), small)
        .groupBy("_null", "_source")
        .agg(F.sum(mass).alias("_got"), F.sum(F.when(rate < cap, mass * F.col("_size") / F.col("_mean")).otherwise(0.0)).alias("_slope"))
    )
    off = F.col("_got") - F.col("_target")
    return (
        state.join(F.broadcast(sums) if small else sums, ["_null", "_source"], "left")
        .withColumns(
            {
                # An interval that no number divides has no better lambda.
                "_off": F.when(F.col("_open") & (F.col("_hi") - F.col("_lo") > 1e-13 * F.greatest(F.abs(F.col("_lo")), F.lit(1.0))), F.abs(off) / F.greatest(F.col("_target"), F.lit(1e-300))).otherwise(0.0),
                "_lo": F.when(F.col("_open") & (off < 0), F.col("_lambda")).otherwise(F.col("_lo")),
                "_hi": F.when(F.col("_open") & (off > 0), F.col("_lambda")).otherwise(F.col("_hi")),
                "_step": F.col("_lambda") - off / F.greatest(F.col("_slope"), F.lit(1e-300)),
            }
        )
        .withColumn(
            "_lambda",
            F.when(F.col("_off") <= TOLERANCE, F.col("_lambda"))
            .when((F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi")), F.col("_step"))
            .otherwise((F.col("_lo") + F.col("_hi")) / 2),
        )
        .drop("_got", "_slope", "_step")
    )


def _settle(sizes: DataFrame, state: DataFrame, cap: int, small: bool) -> DataFrame:
    """Move each lambda until the rounded words are below the target by less than a copy.

    With u fixed, the rounded words never fall as lambda rises, and each step up is one
    copy of one document.  A pass tries TRIED values and keeps the interval in which the
    target is passed.  Returns the sources with _lambda and what is _left of their target."""
    key = ["_null", "_source"]
    keep = [*key, "_total", "_target", "_mean", "_open"]
    width = F.greatest(0.5 * F.abs(F.col("_lambda")), F.lit(0.5))
    nothing = F.lit(None).cast("double")
    state = state.select(*keep, (F.col("_lambda") - width).alias("_lo"), (F.col("_lambda") + width).alias("_hi"), nothing.alias("_under"))
    for n in range(PASSES):
        tried = (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / (TRIED - 1)).alias("_tried")
        values = state.where("_open").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(TRIED - 1)))).select(*key, "_target", "_mean", tried)
        got = _join(sizes.where("_size > 0"), values, small).groupBy(*key, "_target", "_tried").agg(F.sum(F.col("_size") * _copies(F.col("_tried"), cap)).cast("double").alias("_got"))
        fits = F.col("_got") <= F.col("_target")
        ends = got.groupBy(*key).agg(F.max(F.when(fits, F.struct(F.col("_tried").alias("at"), F.col("_got").alias("got")))).alias("_low"), F.min(F.when(~fits, F.col("_tried"))).alias("_high"))
        seen = state.join(F.broadcast(ends) if small else ends, key, "left")
        state = seen.select(
            *keep,
            F.coalesce(F.col("_low.at"), 2 * F.col("_lo") - F.col("_hi")).alias("_lo"),
            F.coalesce(F.col("_high"), 2 * F.col("_hi") - F.col("_lo")).alias("_hi"),
            F.coalesce(F.col("_low.got"), F.col("_under")).alias("_under"),
        )
        if n % 2 or n == PASSES - 1:
            state = stored(state)
    # Sources that cannot reach their target without the ceiling get the ceiling.
    full = F.col("_mean") * math.log(cap) + 1.0
    left = F.when(F.col("_open"), F.coalesce(F.col("_target") - F.col("_under"), F.lit(0.0))).otherwise(0.0)
    return state.select(*keep, F.when(F.col("_open"), F.col("_lo")).otherwise(full).alias("_lambda"), left.alias("_left"))


def _fill(sizes: DataFrame, state: DataFrame, cap: int, small: bool) -> DataFrame:
    """(_null, _source, doc_id, _size): documents of which one copy more is taken.

    From the largest size that fits into what is left of a source to the smallest, as many
    as fit are taken; the histogram of those sizes is what a fold by source sees.  Rows
    that share a doc_id and size, and rows without a doc_id, are left out of this."""
    key = ["_null", "_source"]
    open_ = _join(sizes.where("_size > 0 and doc_id is not null"), state.where("_left >= 1").select(*key, "_mean", "_lambda", "_left"), small)
    open_ = open_.where((F.col("_size") <= F.col("_left")) & (_copies(F.col("_lambda"), cap) < cap))
    units = open_.groupBy(*key, "_left", "doc_id", "_size").agg(F.count("*").alias("_n")).where("_n = 1")
    nth = F.row_number().over(Window.partitionBy(*key, "_size").orderBy(F.xxhash64("doc_id", F.lit("fill")), "doc_id"))
    units = stored(units.withColumn("_nth", nth).where(F.col("_nth") <= FILL_DOCS))
    found = units.groupBy(*key, "_left", "_size").agg(F.max("_nth").alias("_n"))
    by_size = Window.partitionBy(*key).orderBy(F.desc("_size"))
    small_first = Window.partitionBy(*key).orderBy("_size")
    found = found.withColumns({"_a": F.row_number().over(by_size), "_b": F.row_number().over(small_first)}).where((F.col("_a") <= FILL_SIZES) | (F.col("_b") <= FILL_SIZES))
    every = found.groupBy(*key, "_left").agg(F.sort_array(F.collect_list(F.struct("_size", "_n")), asc=False).alias("_sizes"))
    nothing = F.array().cast("array<struct<_size:bigint,_take:bigint>>")

    def take(at: Column, x: Column) -> Column:
        n = F.least(x["_n"].cast("long"), F.floor(at["left"] / x["_size"]).cast("long"))
        more = F.struct((at["left"] - n * x["_size"]).alias("left"), F.concat(at["took"], F.array(F.struct(x["_size"].cast("long").alias("_size"), n.alias("_take")))).alias("took"))
        return F.when(n > 0, more).otherwise(at)

    took = F.aggregate("_sizes", F.struct(F.col("_left").alias("left"), nothing.alias("took")), take)["took"]
    wanted = every.select(*key, F.inline(took))
    return units.join(wanted, [*key, "_size"]).where(F.col("_nth") <= F.col("_take")).select(*key, "doc_id", "_size")


def _decided(rows: DataFrame, sizes: DataFrame, state: DataFrame, cap: int, small: bool) -> DataFrame:
    """*rows* with their source's solution and _number, the copies taken of them."""
    more = stored(_fill(sizes, state, cap, small)).withColumn("_more", F.lit(1))
    more = F.broadcast(more) if more.limit(BROADCAST_FILLED + 1).count() <= BROADCAST_FILLED else more
    out = _join(rows, state, small).join(more, ["_null", "_source", "doc_id", "_size"], "left")
    return out.withColumn("_number", (_copies(F.col("_lambda"), cap) + F.coalesce("_more", F.lit(0))).cast("int"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """*docs* (doc_id, text, source and any other columns) with four columns more.

    size: words of the text (null: 0); source_size: words of its source; target: words
    that the source should give; copies: how often the mix takes the document, from 0 to
    *cap* (1 where it has no words).  Null is a source of its own, the last.  Rows with
    the same doc_id and size get the same copies; an empty table gives no rows.  Own
    columns of those four names are replaced.
    """
    sizes, state, small = solve(docs, weights, cap)
    new = {"size": "_size", "source_size": "_total", "target": "_target", "copies": "_number"}
    keep = [F.col(f"_doc.`{c}`") for c in docs.columns if c.lower() not in new]
    return _decided(_keyed(docs), sizes, state, cap, small).select(*keep, *(F.col(own).alias(name) for name, own in new.items()))


def repeat(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Every row of *docs*, with the columns that it has, as often as mix() takes it."""
    sizes, state, small = solve(docs, weights, cap)
    taken = _decided(_keyed(docs), sizes, state, cap, small).where("_number > 0")
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_number"))))
    return taken.select(*(F.col(f"_doc.`{c}`") for c in docs.columns))


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """As mix(), but only doc_id, source and the four columns, without a second read of the texts."""
    sizes, state, small = solve(docs, weights, cap)
    source = F.when(~F.col("_null"), F.col("_source"))
    return _decided(sizes, sizes, state, cap, small).select("doc_id", source.alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_number").alias("copies"))
