"""Snapshot dedupe: records of one cell are cumulative exports, never additive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S


def _conflict() -> Column:
    """Whether some winner's metrics differ from the first winner's by more than the tolerance.

    With |v - first| <= tol for all v being (max - first <= tol and first - min <= tol),
    extremes suffice.  Null equals null only; NaN equals any number.
    """
    out = F.lit(False)
    for m in S.METRIC_COLUMNS:
        first, low, high = F.col(f"_first.{m}"), F.col(f"_low_{m}"), F.col(f"_high_{m}")
        nulls = F.col(f"_nulls_{m}")
        mixed = (nulls > 0) & (nulls < F.col("_winners"))
        number = first.isNotNull() & ~F.isnan(first)
        # Equal infinities differ by NaN, which is no difference either.
        far = ((high - first) > S.VECTOR_TOLERANCE) & ~F.isnan(high - first) | ((first - low) > S.VECTOR_TOLERANCE) & ~F.isnan(first - low)
        out = out | mixed | F.coalesce(number & far, F.lit(False))
    return out


def dedupe_snapshots(records: DataFrame) -> DataFrame:
    """*records* with is_duplicate_dropped, is_snapshot_conflict, retained; warnings appended.

    Of the well-formed records of a (cohort, sym, asset_class, cell) the largest PAIR
    stays, of equal ones the last.  If equal ones differ in their metrics, all of them are
    flagged.  Two aggregates that combine before the shuffle and joins on the cell, so
    that a cell exported very often is no task of its own.  *records* is read three
    times: persist it if it is dear.
    """
    key = list(S.KEY)
    good = records.where("parse_ok")
    best = good.groupBy(*key).agg(F.max("pair").alias("_most"))
    vector = F.struct(*S.METRIC_COLUMNS)
    sums = [F.count("*").alias("_winners"), F.max("record_index").alias("_chosen"), F.min_by(vector, "record_index").alias("_first")]
    for m in S.METRIC_COLUMNS:
        v = F.when(~F.isnan(m), F.col(m))
        sums += [F.min(v).alias(f"_low_{m}"), F.max(v).alias(f"_high_{m}"), F.count_if(F.col(m).isNull()).alias(f"_nulls_{m}")]
    winners = good.join(best, key).where("pair = _most").groupBy(*key, "_most").agg(*sums)
    winners = winners.select(*key, "_most", "_winners", "_chosen", _conflict().alias("_conflict"))
    place = " for the same COHORT/SYM/CLASS/CELL"
    lost = F.concat(F.lit("snapshot duplicate: PAIR="), F.col("pair").cast("string"), F.lit(" superseded by a later/larger snapshot with PAIR="), F.col("_most").cast("string"), F.lit(place))
    clash = F.concat(
        F.lit("snapshot conflict: "), F.col("_winners").cast("string"), F.lit(" records share PAIR="), F.col("_most").cast("string"),
        F.lit(f"{place} with differing metrics; retained the last encountered (record_index="), F.col("_chosen").cast("string"), F.lit(")"),
    )
    flagged = (F.col("pair") == F.col("_most")) & F.col("_conflict")
    judged = good.join(winners, key).select(
        *records.columns[: records.columns.index("warnings")],
        F.concat("warnings", F.array_compact(F.array(F.when(F.col("pair") < F.col("_most"), lost), F.when(flagged, clash)))).alias("warnings"),
        (F.col("record_index") != F.col("_chosen")).alias("is_duplicate_dropped"), flagged.alias("is_snapshot_conflict"), (F.col("record_index") == F.col("_chosen")).alias("retained"),
    )
    no = F.lit(False)
    return judged.unionByName(records.where("not parse_ok").select("*", no.alias("is_duplicate_dropped"), no.alias("is_snapshot_conflict"), no.alias("retained")))
