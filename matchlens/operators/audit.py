"""Projections and counters over records that went through dedupe, validation and derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S


def eligible(records: DataFrame) -> DataFrame:
    """The records that every aggregate sees: retained and valid, 28 columns."""
    return records.where("retained and valid").select(*S.ELIGIBLE_COLUMNS)


def audit(records: DataFrame) -> DataFrame:
    """All records, 19 columns, messages joined with '; '."""
    joined = {c: F.array_join(c, "; ").alias(c) for c in ("parse_errors", "warnings")}
    extra = {"eligible": (F.col("retained") & F.col("valid")).alias("eligible")}
    return records.select(*((joined | extra).get(c, F.col(c)) for c in S.AUDIT_COLUMNS))


def integrity(records: DataFrame) -> DataFrame:
    """One row of counters; its lists name the eligible records' dimensions, those without pairs included."""
    ok = F.col("retained") & F.col("valid")

    def names(c: str) -> F.Column:
        return F.sort_array(F.collect_set(F.when(ok, F.col(c))))

    return records.agg(
        F.count("*").alias("records_discovered"), F.count_if(ok).alias("records_retained"), F.count_if(~F.col("valid")).alias("records_invalid"),
        F.count_if("is_duplicate_dropped").alias("snapshot_duplicates"), F.count_if("is_snapshot_conflict").alias("snapshot_conflicts"),
        names("cohort").alias("cohorts"), names("sym").alias("markets"), names("asset_class").alias("asset_classes"),
        F.coalesce(F.sum(F.when(ok, F.col("pair"))), F.lit(0)).alias("pair_total"),
    )
