"""Fields, domains, thresholds and table schemas of the record format, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values of the record format -------------------------------------------------
MARKER = "T44C"
IDENTITY = ("SYM", "CLASS", "COHORT", "CELL")
METRICS = ("ERET", "CRET", "DRET", "EHIT", "CHIT", "EMFE", "CMFE", "DMFE", "EMAE", "CMAE", "DMAE")
FIELDS = (*IDENTITY, "PAIR", *METRICS)
SIDES = {"B": "BUY", "S": "SELL"}
SOURCES = ("BAND", "DIV")
AGES = ("T01-05", "T06-10", "T11-15", "T16-20")
CELLS = tuple(f"{side}_{source}_{age}" for side in SIDES for source in SOURCES for age in AGES)
READABLE = (".txt", ".log", ".csv")

# ---- Fixed thresholds -------------------------------------------------------------------
ARITHMETIC_TOLERANCE = 1e-3
SIGN_EPSILON = 1e-9  # signs of records; a caller may change it
MARKET_EPSILON = 1e-9  # signs of market means; always this
VECTOR_TOLERANCE = 1e-9
MARKET_CONCENTRATION, CLASS_CONCENTRATION = 0.50, 0.70
MATURITY = ((5, "EMBRYONIC"), (10, "EARLY"), (20, "DEVELOPING"), (None, "MATURE"))
BREADTH = ((1, "SINGLE_MARKET"), (2, "LIMITED_BREADTH"), (4, "MULTI_MARKET"), (None, "BROAD"))
SHARE = 0.60
CROSS_MARKET_PAIRS, CROSS_MARKET_MARKETS = 20, 5
LEAST_PAIRS, LEAST_MARKETS = 5, 2
VERDICTS = {
    "INSUFFICIENT": "INSUFFICIENT_CROSS_MARKET_EVIDENCE",
    "EARLY_MIXED": "MIXED",
    "EARLY_CONSISTENT_POS": "ACCUMULATE",
    "EARLY_CONSISTENT_NEG": "ACCUMULATE",
    "CROSS_MARKET_POS": "DESCRIPTIVE_POSITIVE",
    "CROSS_MARKET_NEG": "DESCRIPTIVE_NEGATIVE",
}
DEFAULT_VERDICT = "MIXED"

# ---- Fixed columns of the tables --------------------------------------------------------
METRIC_COLUMNS = tuple(m.lower() for m in METRICS)
WEIGHTED = ("eret", "cret", "dret", "ehit", "chit", "delta_hit", "emfe", "cmfe", "dmfe", "emae", "cmae", "dmae")
CONSISTENCY = ("dret", "delta_hit", "dmfe", "dmae")
KEY = ("cohort", "sym", "asset_class", "cell")

ELIGIBLE_COLUMNS = (
    "record_index", "source_file", "sym", "asset_class", "cohort", "cell", "side", "source", "age_bucket", "pair",
    "eret", "cret", "dret", "ehit", "chit", "delta_hit", "emfe", "cmfe", "dmfe", "emae", "cmae", "dmae",
    "dret_sign", "dmfe_sign", "dmae_sign", "ret_delta_ok", "mfe_delta_ok", "mae_delta_ok",
)
AUDIT_COLUMNS = (
    "record_index", "source_file", "sym", "asset_class", "cohort", "cell", "pair", "parse_ok", "valid", "retained", "eligible",
    "is_duplicate_dropped", "is_snapshot_conflict", "ret_delta_ok", "mfe_delta_ok", "mae_delta_ok", "parse_errors", "warnings", "raw_text",
)
SUMMARY_COLUMNS = (
    "GROUP_LEVEL", "GROUP", "MARKETS", "ASSET_CLASSES", "PAIR_TOTAL", *(f"PAIR_WEIGHTED_{m.upper()}" for m in WEIGHTED), "N_MARKETS",
    "POS_DRET_MARKETS", "NEG_DRET_MARKETS", "ZERO_DRET_MARKETS", "DRET_POS_MARKET_SHARE", "MEDIAN_MARKET_DRET", "MIN_MARKET_DRET", "MAX_MARKET_DRET",
    "POS_DELTA_HIT_MARKETS", "NEG_DELTA_HIT_MARKETS", "MEDIAN_MARKET_DELTA_HIT", "POS_DMFE_MARKETS", "NEG_DMFE_MARKETS", "MEDIAN_MARKET_DMFE",
    "POS_DMAE_MARKETS", "NEG_DMAE_MARKETS", "MEDIAN_MARKET_DMAE", "PAIR_SHARE_MAX_MARKET", "PAIR_SHARE_MAX_CLASS",
    "MARKET_CONCENTRATED", "CLASS_CONCENTRATED", "MATCH_COVERAGE", "MATURITY", "BREADTH", "CLASSIFICATION",
)
LEVELS = ("CELL", "SIDE_SOURCE", "SOURCE", "SIDE", "ASSET_CLASS", "MARKET", "COHORT")
#: Columns that a level's table has after SUMMARY_COLUMNS.
LEVEL_COLUMNS = {
    "CELL": ("CELL", "SIDE", "SOURCE", "AGE_BUCKET"), "SIDE_SOURCE": ("SIDE", "SOURCE"), "SOURCE": ("SOURCE",), "SIDE": ("SIDE",),
    "ASSET_CLASS": ("ASSET_CLASS",), "MARKET": ("SYM", "ASSET_CLASS"), "COHORT": ("COHORT",),
}
NO_COHORT = "(no cohort)"

BLOCKS = T.StructType([T.StructField("record_index", T.LongType()), T.StructField("source_file", T.StringType()), T.StructField("block", T.StringType())])

# ---- Fixed columns of the ledger, and where a report has their values -------------------
#: column, kind (s text, l integer, d decimal), origin, name there.  Origins: a field of the
#: manifest (count: how many its list has), a column of the overall or the group table, a digest
#: of a file, the verdict of the report, and what the append itself knows.
CHECKPOINT_SOURCES = (
    ("checkpoint", "s", "append", "label"), ("captured_at_utc", "s", "append", "time"), ("source_generated_at_utc", "s", "manifest", "generated_at_utc"),
    ("source_report_sha256", "s", "digest", "10_report.md"), ("source_manifest_sha256", "s", "digest", "11_manifest.json"), ("pair_total", "l", "manifest", "pair_total"),
    ("markets", "l", "overall", "N_MARKETS"), ("asset_classes", "l", "count", "asset_classes"), ("records_retained", "l", "manifest", "records_retained"),
    ("dret", "d", "overall", "PAIR_WEIGHTED_DRET"), ("delta_hit", "d", "overall", "PAIR_WEIGHTED_DELTA_HIT"), ("dmfe", "d", "overall", "PAIR_WEIGHTED_DMFE"), ("dmae", "d", "overall", "PAIR_WEIGHTED_DMAE"),
    ("positive_market_share", "d", "overall", "DRET_POS_MARKET_SHARE"), ("median_market_dret", "d", "overall", "MEDIAN_MARKET_DRET"),
    ("maturity", "s", "overall", "MATURITY"), ("breadth", "s", "overall", "BREADTH"), ("classification", "s", "overall", "CLASSIFICATION"), ("research_verdict", "s", "verdict", ""),
)
TREND_SOURCES = (
    ("checkpoint", "s", "append", "label"), ("captured_at_utc", "s", "append", "time"), ("group", "s", "group", "GROUP"), ("pairs", "l", "group", "PAIR_TOTAL"), ("markets", "l", "group", "MARKETS"),
    ("dret", "d", "group", "PAIR_WEIGHTED_DRET"), ("delta_hit", "d", "group", "PAIR_WEIGHTED_DELTA_HIT"), ("positive_market_share", "d", "group", "DRET_POS_MARKET_SHARE"),
    ("maturity", "s", "group", "MATURITY"), ("breadth", "s", "group", "BREADTH"), ("classification", "s", "group", "CLASSIFICATION"),
)
_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
CHECKPOINTS, TREND = (T.StructType([T.StructField(name, _KINDS[kind]) for name, kind, _, _ in spec]) for spec in (CHECKPOINT_SOURCES, TREND_SOURCES))
TREND_GROUPS = ("BAND", "DIV", "B_BAND", "B_DIV", "S_BAND", "S_DIV")
