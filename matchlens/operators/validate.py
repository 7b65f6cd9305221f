"""Semantic validation of records, and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions.labels import sign
from matchlens.functions.text import shown


def reconciles(event: Column, control: Column, delta: Column, tolerance: float) -> Column:
    """Whether delta is event - control within *tolerance*; null if one is null."""
    return F.abs((event - control) - delta) <= tolerance


def validate(records: DataFrame, tolerance: float = S.ARITHMETIC_TOLERANCE) -> DataFrame:
    """*records* with valid settled, {ret,mfe,mae}_delta_ok, and warnings appended.

    Runs on dropped duplicates too, after dedupe: an invalid largest snapshot takes its
    cell with it.  Deltas that do not reconcile are warned of only; a field missing from a
    record with pairs, or a hit rate outside 0 to 100, makes it invalid.
    """
    checks = {"ret": ("eret", "cret", "dret"), "mfe": ("emfe", "cmfe", "dmfe"), "mae": ("emae", "cmae", "dmae")}
    ok = {f"{k}_delta_ok": F.when(F.col("parse_ok"), reconciles(F.col(e), F.col(c), F.col(d), tolerance)) for k, (e, c, d) in checks.items()}
    deltas = [
        F.when(F.col(f"{k}_delta_ok") == F.lit(False), f"{d.upper()} does not reconcile with event-control within tolerance ({tolerance!r}) -- retained, flagged for audit only")
        for k, (_, _, d) in checks.items()
    ]
    issues = [F.when((F.col("pair") > 0) & ~F.col("field_present")[m], f"{m} missing for a PAIR>0 record") for m in S.METRICS]
    for m in ("ehit", "chit"):
        outside = F.col(m).isNotNull() & ~F.col(m).between(0, 100)
        issues.append(F.when(outside, F.concat(F.lit(f"{m.upper()}="), shown(F.col(m)), F.lit(" outside expected range [0,100]"))))
    found = records.withColumns(ok).withColumn("_issues", F.when(F.col("parse_ok"), F.array_compact(F.array(*issues))).otherwise(F.array().cast("array<string>")))
    return found.withColumns(
        {
            "valid": F.col("parse_ok") & (F.size("_issues") == 0),
            "warnings": F.when(F.col("parse_ok"), F.concat("warnings", F.array_compact(F.array(*deltas)), "_issues")).otherwise(F.col("warnings")),
        }
    ).drop("_issues")


def derive(records: DataFrame, epsilon: float = S.SIGN_EPSILON) -> DataFrame:
    """*records* with delta_hit (null if either rate is) and the signs of the three deltas."""
    return records.withColumns({"delta_hit": F.col("ehit") - F.col("chit")} | {f"{m}_sign": sign(F.col(m), epsilon) for m in ("dret", "dmfe", "dmae")})
