"""Queries over driver tables, and for each the same result in independent SQL.

The queries run the whole engine from record text; the SQL starts from the tables'
columns and uses plain windows and one aggregate per level.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens import operators as O
from matchlens import schema as S
from matchlens.functions import labels
from matchlens.plans import adapters
from matchlens.plans.ledger import appended, latest, trend
from matchlens.sources import blocks_from_text, file_hashes, list_inputs, read_blocks
from matchlens.sources.shared import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]


#: Added before rounding, here and in the SQL, so that a last bit does not decide a tie.
NUDGE = 1e-9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums differ in their last bits between engines."""
    return df.select(*(F.round(F.col(c) + NUDGE, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.parse_records(adapters.order_blocks(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(parsed(spark, sf_dir))


def _settled(found: DataFrame) -> DataFrame:
    # Dedupe reads the records three times.
    return written(found).transform(O.dedupe_snapshots).transform(O.validate).transform(O.derive)


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Aggregates need neither the text nor the fields as they were written.
    return O.eligible(_settled(parsed(spark, sf_dir).drop("raw_text", "field_raw")))


# ---- The independent SQL ------------------------------------------------------------------

_KEY = "cohort, sym, asset_class, cell"
_M = S.METRIC_COLUMNS
_THOUSANDTHS = {
    "eret": "(i * 37) % 2001 - 1000", "cret": "(i * 53) % 1501 - 700", "dret": "(i * 37) % 2001 - 1000 - ((i * 53) % 1501 - 700) + CASE WHEN i % 17 = 0 THEN 5 ELSE 0 END",
    "ehit": "CASE WHEN i % 211 = 0 THEN 150000 ELSE (i % 101) * 1000 END", "chit": "((i * 7) % 101) * 1000",
    "emfe": "(i * 29) % 1800", "cmfe": "(i * 31) % 1600", "dmfe": "(i * 29) % 1800 - (i * 31) % 1600 + CASE WHEN i % 19 = 0 THEN 7 ELSE 0 END",
    "emae": "-((i * 23) % 1700)", "cmae": "-((i * 41) % 1900)", "dmae": "(i * 41) % 1900 - (i * 23) % 1700",
}
_BASE = f"""
WITH keys AS (
  SELECT o_orderkey AS i, n_name AS sym, r_name AS asset_class, 'C-' || o_orderstatus AS cohort,
         CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS code, CASE WHEN o_custkey % 3 = 0 THEN 'DIV' ELSE 'BAND' END AS source,
         CASE WHEN o_orderkey % 97 = 0 THEN 'T21-25' ELSE CASE month(o_orderdate) % 4 WHEN 0 THEN 'T01-05' WHEN 1 THEN 'T06-10' WHEN 2 THEN 'T11-15' ELSE 'T16-20' END END AS age_bucket
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (SELECT *, code || '_' || source || '_' || age_bucket AS cell, CASE code WHEN 'B' THEN 'BUY' ELSE 'SELL' END AS side, CAST(i % 7 AS BIGINT) AS pair,
         i % 503 <> 0 AS parse_ok, {", ".join(f"CASE WHEN i % 7 = 0 THEN NULL ELSE CAST({e} AS DOUBLE) / 1000 END AS v_{m}" for m, e in _THOUSANDTHS.items())} FROM keys),
rec AS (SELECT * EXCLUDE ({", ".join(f"v_{m}" for m in _M)}), {", ".join(f"v_{m} AS {m}" for m in _M if m not in ("eret", "cmae"))},
         CASE WHEN i % 307 = 0 THEN NULL ELSE v_eret END AS eret, CASE WHEN parse_ok THEN v_cmae END AS cmae FROM raw),
top AS (SELECT *, max(pair) OVER (PARTITION BY {_KEY}) AS most FROM rec WHERE parse_ok),
win AS (SELECT *, {", ".join(f"first_value({m}) OVER w AS f_{m}" for m in _M)}, count(*) OVER (PARTITION BY {_KEY}) AS winners, max(i) OVER (PARTITION BY {_KEY}) AS chosen
        FROM top WHERE pair = most WINDOW w AS (PARTITION BY {_KEY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
clash AS (SELECT {_KEY}, max(winners) AS winners, max(chosen) AS chosen,
          bool_or({" OR ".join(f"(({m} IS NULL) <> (f_{m} IS NULL)) OR coalesce(abs({m} - f_{m}) > 1e-9, FALSE)" for m in _M)}) AS conflict FROM win GROUP BY {_KEY}),
ded AS (SELECT top.*, top.i <> chosen AS is_duplicate_dropped, pair = most AND conflict AS is_snapshot_conflict, top.i = chosen AS retained, winners, chosen FROM top JOIN clash USING ({_KEY})
        UNION ALL BY NAME SELECT *, FALSE AS is_duplicate_dropped, FALSE AS is_snapshot_conflict, FALSE AS retained FROM rec WHERE NOT parse_ok),
val AS (SELECT *, parse_ok AND NOT (pair > 0 AND i % 307 = 0) AND coalesce(ehit BETWEEN 0 AND 100, TRUE) AND coalesce(chit BETWEEN 0 AND 100, TRUE) AS valid,
        CASE WHEN parse_ok THEN abs((eret - cret) - dret) <= 1e-3 END AS ret_delta_ok, CASE WHEN parse_ok THEN abs((emfe - cmfe) - dmfe) <= 1e-3 END AS mfe_delta_ok,
        CASE WHEN parse_ok THEN abs((emae - cmae) - dmae) <= 1e-3 END AS mae_delta_ok, ehit - chit AS delta_hit,
        {", ".join(f"CASE WHEN {m} > 1e-9 THEN 1 WHEN {m} < -1e-9 THEN -1 ELSE 0 END AS {m}_sign" for m in ("dret", "dmfe", "dmae"))} FROM ded),
elig AS (SELECT i AS record_index, 'orders' AS source_file, * EXCLUDE (i) FROM val WHERE retained AND valid)
"""


def _r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) AS {name or c}"


def _list(domain: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in domain) + ") AS d(g)"


_GROUP = {"CELL": "cell", "SIDE_SOURCE": "code || '_' || source", "SOURCE": "source", "SIDE": "side", "ASSET_CLASS": "asset_class", "MARKET": "sym", "COHORT": "cohort"}
_DOMAIN = {"CELL": S.CELLS, "SIDE_SOURCE": ("B_BAND", "B_DIV", "S_BAND", "S_DIV"), "SOURCE": S.SOURCES, "SIDE": ("BUY", "SELL")}


def _level(level: str, source: str = "elig", extra: str = "") -> str:
    """The summary columns of one level: markets and classes aggregated on their own."""
    group = _GROUP[level]
    mean = lambda m: f"sum({m} * pair) FILTER (pair > 0 AND {m} IS NOT NULL) / sum(pair) FILTER (pair > 0 AND {m} IS NOT NULL)"
    spine = f"SELECT g FROM {_list(_DOMAIN[level])}" if level in _DOMAIN else f"SELECT DISTINCT {group} AS g FROM {source}"
    per_market = f"SELECT {group} AS g, sym, sum(pair) AS p, {', '.join(f'{mean(m)} AS {m}' for m in S.CONSISTENCY)} FROM {source} GROUP BY 1, 2"
    counts = ", ".join(f"count(*) FILTER ({m} > 1e-9) AS pos_{m}, count(*) FILTER ({m} < -1e-9) AS neg_{m}, count({m}) AS n_{m}, median({m}) AS med_{m}" for m in S.CONSISTENCY)
    weighted = ", ".join(f"round(t.w_{m}, 6) AS PAIR_WEIGHTED_{m.upper()}" for m in S.WEIGHTED)
    zero = lambda c: f"CAST(coalesce({c}, 0) AS BIGINT)"
    share, neg = "m.pos_dret / nullif(CAST(m.n_dret AS DOUBLE), 0)", "coalesce(m.neg_dret, 0) / nullif(CAST(m.markets AS DOUBLE), 0)"
    up, down, total = f"coalesce({share}, 0e0)", f"coalesce({neg}, 0e0)", zero("t.p")
    wide = f"{total} >= 20 AND {zero('m.markets')} >= 5"
    return f"""
SELECT '{level}' AS GROUP_LEVEL, s.g AS "GROUP", {zero("m.markets")} AS MARKETS, {zero("c.classes")} AS ASSET_CLASSES, {total} AS PAIR_TOTAL, {weighted}, {zero("m.markets")} AS N_MARKETS,
  {", ".join(f"{zero(f'm.{x}_{k}')} AS {x.upper()}_{k.upper()}_MARKETS" for k in S.CONSISTENCY for x in ("pos", "neg"))},
  {zero("m.n_dret - m.pos_dret - m.neg_dret")} AS ZERO_DRET_MARKETS, round({share}, 6) AS DRET_POS_MARKET_SHARE,
  {", ".join(f"round(m.med_{k}, 6) AS MEDIAN_MARKET_{k.upper()}" for k in S.CONSISTENCY)}, round(m.low, 6) AS MIN_MARKET_DRET, round(m.high, 6) AS MAX_MARKET_DRET,
  round(coalesce(m.top / nullif(CAST(t.p AS DOUBLE), 0), 0e0), 6) AS PAIR_SHARE_MAX_MARKET, round(coalesce(c.top / nullif(CAST(t.p AS DOUBLE), 0), 0e0), 6) AS PAIR_SHARE_MAX_CLASS,
  coalesce(m.top / nullif(CAST(t.p AS DOUBLE), 0), 0e0) > 0.5e0 AS MARKET_CONCENTRATED, coalesce(c.top / nullif(CAST(t.p AS DOUBLE), 0), 0e0) > 0.7e0 AS CLASS_CONCENTRATED, 'NOT_AVAILABLE' AS MATCH_COVERAGE,
  CASE WHEN {total} < 5 THEN 'EMBRYONIC' WHEN {total} < 10 THEN 'EARLY' WHEN {total} < 20 THEN 'DEVELOPING' ELSE 'MATURE' END AS MATURITY,
  CASE WHEN {zero("m.markets")} <= 1 THEN 'SINGLE_MARKET' WHEN m.markets = 2 THEN 'LIMITED_BREADTH' WHEN m.markets <= 4 THEN 'MULTI_MARKET' ELSE 'BROAD' END AS BREADTH,
  CASE WHEN {total} < 5 OR {zero("m.markets")} < 2 THEN 'INSUFFICIENT' WHEN {wide} AND t.w_dret > 0 AND {up} >= 0.6e0 THEN 'CROSS_MARKET_POS' WHEN {wide} AND t.w_dret < 0 AND {down} >= 0.6e0 THEN 'CROSS_MARKET_NEG'
       WHEN t.w_dret > 0 AND {up} > 0.6e0 THEN 'EARLY_CONSISTENT_POS' WHEN t.w_dret < 0 AND {down} > 0.6e0 THEN 'EARLY_CONSISTENT_NEG' ELSE 'EARLY_MIXED' END AS CLASSIFICATION{extra}
FROM ({spine}) s
LEFT JOIN (SELECT {group} AS g, sum(pair) AS p, min_by(asset_class, record_index) AS first_class, {", ".join(f"{mean(m)} AS w_{m}" for m in S.WEIGHTED)} FROM {source} GROUP BY 1) t ON t.g = s.g
LEFT JOIN (SELECT g, count(*) FILTER (p > 0) AS markets, max(p) AS top, min(dret) AS low, max(dret) AS high, {counts} FROM ({per_market}) GROUP BY g) m ON m.g = s.g
LEFT JOIN (SELECT g, count(*) FILTER (p > 0) AS classes, max(p) AS top FROM (SELECT {group} AS g, asset_class, sum(pair) AS p FROM {source} GROUP BY 1, 2) GROUP BY g) c ON c.g = s.g
"""


_OWN = {
    "CELL": ", s.g AS CELL, CASE WHEN s.g LIKE 'B%' THEN 'BUY' ELSE 'SELL' END AS SIDE, split_part(s.g, '_', 2) AS SOURCE, split_part(s.g, '_', 3) AS AGE_BUCKET",
    "SIDE_SOURCE": ", CASE WHEN s.g LIKE 'B%' THEN 'BUY' ELSE 'SELL' END AS SIDE, split_part(s.g, '_', 2) AS SOURCE", "SOURCE": ", s.g AS SOURCE", "SIDE": ", s.g AS SIDE",
    "ASSET_CLASS": ", s.g AS ASSET_CLASS", "MARKET": ", s.g AS SYM, t.first_class AS ASSET_CLASS", "COHORT": ", s.g AS COHORT",
}
_ALL = _BASE + " UNION ALL ".join(_level(x) for x in S.LEVELS)


def _from_levels(sql: str) -> str:
    return _BASE + f", lv AS ({' UNION ALL '.join(_level(x) for x in S.LEVELS)}) {sql}"


# ---- The queries ----------------------------------------------------------------------------


def _summary(level: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.summarize(eligible(spark, sf_dir), level))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.summarize_all(eligible(spark, sf_dir)).drop("_class", "_order"))


def _of_levels(columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("GROUP_LEVEL", "GROUP", *columns)


def _top_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadest, strongest positive and strongest negative cell; ties go to the first in order."""
    cells = O.summarize_all(eligible(spark, sf_dir), ["CELL"]).where("PAIR_TOTAL > 0")
    w, first = F.col("PAIR_WEIGHTED_DRET"), -F.col("_order")
    best = cells.agg(
        F.max_by("GROUP", F.struct("MARKETS", first.alias("o"))).alias("broadest"), F.max_by("GROUP", F.struct(w, first.alias("o"))).alias("top"), F.max(w).alias("top_dret"),
        F.max_by("GROUP", F.when(w.isNotNull(), F.struct((-w).alias("w"), first.alias("o")))).alias("low"), F.min(w).alias("low_dret"),
    )
    return rounded(best.select("broadest", F.when(F.col("top_dret") > 0, F.col("top")).alias("positive"), F.when(F.col("top_dret") > 0, F.col("top_dret")).alias("positive_dret"), F.when(F.col("low_dret") < 0, F.col("low")).alias("negative"), F.when(F.col("low_dret") < 0, F.col("low_dret")).alias("negative_dret")))


def _sort_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = O.summarize_all(eligible(spark, sf_dir), ["CELL"])  # 16 rows
    return cells.select("GROUP", "PAIR_TOTAL", F.row_number().over(Window.orderBy(F.desc("PAIR_TOTAL"), "_order")).cast("long").alias("place"))


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cohort as one checkpoint, in the order of their names."""
    o = O.summarize_all(eligible(spark, sf_dir), ["COHORT"])
    return rounded(o).select(
        F.col("GROUP").alias("checkpoint"), F.col("PAIR_TOTAL").alias("pair_total"), F.col("N_MARKETS").alias("markets"), F.col("PAIR_WEIGHTED_DRET").alias("dret"), F.col("DRET_POS_MARKET_SHARE").alias("positive_market_share"),
        F.col("MEDIAN_MARKET_DRET").alias("median_market_dret"), F.col("CLASSIFICATION").alias("classification"), labels.verdict(F.col("CLASSIFICATION")).alias("research_verdict"),
    )


_VERDICT = "CASE CLASSIFICATION " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.VERDICTS.items()) + " ELSE 'MIXED' END"
_CHECKPOINTS = f"""SELECT "GROUP" AS checkpoint, PAIR_TOTAL AS pair_total, N_MARKETS AS markets, PAIR_WEIGHTED_DRET AS dret, DRET_POS_MARKET_SHARE AS positive_market_share, MEDIAN_MARKET_DRET AS median_market_dret,
  CLASSIFICATION AS classification, {_VERDICT} AS research_verdict FROM lv WHERE GROUP_LEVEL = 'COHORT'"""
_LEDGER = f"""SELECT * EXCLUDE (n) REPLACE (CASE WHEN position = n - 1 THEN pair_total + 1000 ELSE pair_total END AS pair_total, CASE WHEN position = n - 1 THEN 2 * position ELSE position END AS position)
  FROM (SELECT *, row_number() OVER (ORDER BY checkpoint) - 1 AS position, count(*) OVER () AS n FROM ({_CHECKPOINTS}))"""


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all(spark, sf_dir).where("GROUP_LEVEL in ('SIDE_SOURCE', 'SOURCE', 'SIDE')")
    return trend(rows.select(F.col("GROUP").alias("group"), F.col("PAIR_TOTAL").alias("pairs"), F.col("MARKETS").alias("markets"), F.col("PAIR_WEIGHTED_DRET").alias("dret"), F.col("CLASSIFICATION").alias("classification")))


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("cohorts", "markets", "asset_classes")
    return O.integrity(records(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in lists})


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One pass over a written table: three plans of their own, each with the dedupe in it four times, fill the driver.
    out = O.summarize_union(written(eligible(spark, sf_dir)), ("SIDE_SOURCE", "SOURCE", "SIDE"), ("SIDE", "SOURCE"))
    return out.select("GROUP", "PAIR_TOTAL", "MARKETS", "CLASSIFICATION", "SIDE", "SOURCE")


def _local(spark: SparkSession) -> Path:
    """A folder for input files: what reads them lists paths of this machine, as a command line does."""
    at = Path(shared_dir(spark).removeprefix("file:"))
    at.mkdir(parents=True)
    return at


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of files, here one for each of the 25 nations with its name in it."""
    at = _local(spark)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").limit(25).collect():
        (at / f"{r['n_nationkey']}.txt").write_text(r["n_name"], encoding="utf-8")
    found = file_hashes(list_inputs([str(at)]))
    return spark.createDataFrame([(Path(k).name, v) for k, v in found.items()], "file string, sha256 string")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from files of a directory, numbered over all of them: paths, scan, decoding, line ends, markers, tokens."""
    at = _local(spark) / "logs"
    texts = adapters.order_texts(spark, sf_dir)
    texts.repartitionByRange(3, "i").sortWithinPartitions("i").select("text").write.text(f"file://{at}")
    found = O.parse_records(read_blocks(spark, [str(at)]))
    return rounded(found.select("record_index", F.element_at(F.split("source_file", "/"), -2).alias("folder"), "sym", "cohort", "cell", "pair", "cret"))


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log noise before and after a record, whose tokens survive."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    record = F.concat(F.lit("\r\nT44C\r\n|SYM=M"), (F.col("doc_id") % 10).cast("string"), F.lit("\r\n|CLASS=X|COHORT=C|CELL=B_DIV_T06-10\n|PAIR=\n|PAIR="), (F.col("doc_id") % 50).cast("string"), F.lit("\r|DRET=NA\n"))
    noise = F.coalesce("text", F.lit(""))
    texts = d.select(F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("source_file"), F.concat(noise, record, noise).alias("text"))
    return O.parse_records(blocks_from_text(texts)).select("record_index", "source_file", "sym", "pair", "parse_ok", F.col("field_present")["DRET"].alias("has_dret"), F.col("field_present")["ERET"].alias("has_eret"))


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.parse_records(adapters.faulty_blocks(spark, sf_dir))
    return found.select("record_index", "parse_ok", "sym", "cell", "pair", F.array_join("parse_errors", "; ").alias("errors"), F.col("field_present")["SYM"].alias("has_sym"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all cohorts but the last, to which all are appended with other counts: what it had stays."""
    found = written(_checkpoints(spark, sf_dir).withColumn("position", F.row_number().over(Window.orderBy("checkpoint")).cast("long") - 1))  # a row for each cohort
    last = found.agg(F.max("position")).first()[0]
    return appended(found.where(F.col("position") < last), found.withColumn("pair_total", F.col("pair_total") + 1000))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.summarize(adapters.event_records(spark, sf_dir), "MARKET"))


def _market_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = O.market_facts(eligible(spark, sf_dir), ["MARKET"]).groupBy("sym").agg(F.sum("_pairs").alias("pairs"), *((F.sum(f"_w_{m}") / F.sum(f"_d_{m}")).alias(m) for m in S.CONSISTENCY))
    return rounded(facts)


def _matrix(which: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    m = O.market_cell_matrices(eligible(spark, sf_dir))[which]
    return rounded(m.select("MARKET", *(F.col(f"`{c}`").alias(c.replace("-", "_")) for c in S.CELLS)))


def _select(source: Query, *columns: str, where: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        return rounded((df.where(where) if where else df).selectExpr(*columns))

    return run


_CELL_SQL = {"w": "sum(dret * pair) FILTER (pair > 0 AND dret IS NOT NULL) / sum(pair) FILTER (pair > 0 AND dret IS NOT NULL)"}
_MATRIX_SQL = (
    ", ".join(f"round(sum(dret * pair) FILTER (cell = '{c}' AND pair > 0 AND dret IS NOT NULL) / sum(pair) FILTER (cell = '{c}' AND pair > 0 AND dret IS NOT NULL), 6) AS \"{c.replace('-', '_')}\"" for c in S.CELLS),
    ", ".join(f"CAST(coalesce(sum(pair) FILTER (cell = '{c}'), 0) AS BIGINT) AS \"{c.replace('-', '_')}\"" for c in S.CELLS),
)
_EVENTS = f"""WITH elig AS (SELECT event_id AS record_index, 'U' || CAST(user_id AS VARCHAR) AS sym, event_type AS asset_class, CAST(event_id % 5 AS BIGINT) AS pair,
  {", ".join(f"CAST((event_id * {13 + 2 * k}) % 2001 - 1000 AS DOUBLE) / 1000 AS {m}" for k, m in enumerate(_M))},
  CAST((event_id * 19) % 2001 - 1000 AS DOUBLE) / 1000 - CAST((event_id * 21) % 2001 - 1000 AS DOUBLE) / 1000 AS delta_hit FROM events) """

_VALUES = ", ".join(_M)
_ROUNDED = ", ".join(_r(m) for m in _M)
_ORDER_CELL = "CASE g " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(S.CELLS)) + " END"

_FAULTS = "CASE i % 5 WHEN 0 THEN 'missing required field SYM' WHEN 1 THEN 'CELL ''B_BAND_XX'' does not match an expected pattern (e.g. B_BAND_T01-05)' WHEN 2 THEN 'PAIR is negative: -4' WHEN 3 THEN 'PAIR is not a valid integer: ''4.5''' ELSE 'DRET is not numeric or NA: ''1,5''' END"
_NUMBER = lambda e: f"CASE WHEN i % 7 = 0 THEN 'NA' ELSE CASE WHEN ({e}) < 0 THEN '-' ELSE '' END || CAST(abs({e}) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs({e}) % 1000 AS VARCHAR), 3, '0') END"
_WRITTEN = {m: _NUMBER(e) for m, e in _THOUSANDTHS.items()}
_WRITTEN["eret"] = f"CASE WHEN i % 307 <> 0 OR i % 7 = 0 THEN {_WRITTEN['eret']} END"
_WRITTEN["cmae"] = f"CASE WHEN i % 503 = 0 THEN 'n/a?' ELSE {_WRITTEN['cmae']} END"
_FIELDS = "concat_ws('|', 'SYM=' || sym, 'CLASS=' || asset_class, 'COHORT=' || cohort, 'CELL=' || cell, 'PAIR=' || pair, " + ", ".join(f"'{m.upper()}=' || ({e})" for m, e in _WRITTEN.items()) + ")"
_RAW = f"CASE WHEN i % 2 = 0 THEN 'T44C|' || {_FIELDS} || chr(10) || '[log] bar closed' ELSE 'T44C' || chr(10) || '| pair = 999' || chr(10) || '|' || replace({_FIELDS}, '|', ' ' || chr(10) || '| ') || chr(10) || chr(10) || 'plot | not=a|field=either' END"
_SNAPSHOT = """CASE WHEN pair < most THEN 'snapshot duplicate: PAIR=' || pair || ' superseded by a later/larger snapshot with PAIR=' || most || ' for the same COHORT/SYM/CLASS/CELL'
          WHEN is_snapshot_conflict THEN 'snapshot conflict: ' || winners || ' records share PAIR=' || most || ' for the same COHORT/SYM/CLASS/CELL with differing metrics; retained the last encountered (record_index=' || chosen || ')' END"""
_DELTAS = ", ".join(f"CASE WHEN NOT {k}_delta_ok THEN '{m} does not reconcile with event-control within tolerance (0.001) -- retained, flagged for audit only' END" for k, m in (("ret", "DRET"), ("mfe", "DMFE"), ("mae", "DMAE")))
_WARNINGS = f"""CASE WHEN NOT parse_ok THEN 'CMAE is not numeric or NA: ''n/a?''' ELSE concat_ws('; ', {_SNAPSHOT}, {_DELTAS}, CASE WHEN pair > 0 AND i % 307 = 0 THEN 'ERET missing for a PAIR>0 record' END, CASE WHEN ehit > 100 THEN 'EHIT=150.0 outside expected range [0,100]' END) END"""

#: name: (query, its SQL or None)
CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "parse_roundtrip": (_select(parsed, "record_index", "sym", "asset_class", "cohort", "cell", "pair", *_M), _BASE + f"SELECT i AS record_index, sym, asset_class, cohort, cell, pair, {_ROUNDED} FROM rec"),
    "parse_noise_multiline": (_noise, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS record_index, CAST(doc_id AS VARCHAR) AS source_file, 'M' || CAST(doc_id % 10 AS VARCHAR) AS sym, CAST(doc_id % 50 AS BIGINT) AS pair, TRUE AS parse_ok, TRUE AS has_dret, FALSE AS has_eret FROM documents"),
    "path_scan": (_scan, _BASE + f"SELECT row_number() OVER (ORDER BY i) - 1 AS record_index, 'logs' AS folder, sym, cohort, cell, pair, {_r('cret')} FROM rec"),
    "parse_identity_errors": (_faults, _BASE + f"SELECT i AS record_index, FALSE AS parse_ok, CASE WHEN i % 5 <> 0 THEN sym END AS sym, CASE WHEN i % 5 = 1 THEN 'B_BAND_XX' ELSE cell END AS cell, CASE WHEN i % 5 NOT IN (2, 3) THEN pair END AS pair, {_FAULTS} AS errors, i % 5 <> 0 AS has_sym FROM rec WHERE i % 7 <> 0 AND i % 503 <> 0"),
    "cell_decompose": (_select(parsed, "record_index", "side", "source", "age_bucket"), _BASE + "SELECT i AS record_index, side, source, age_bucket FROM rec"),
    "parse_errors": (_select(parsed, "record_index", "array_join(parse_errors, '; ') AS errors", where="not parse_ok"), _BASE + "SELECT i AS record_index, 'CMAE is not numeric or NA: ''n/a?''' AS errors FROM rec WHERE NOT parse_ok"),
    "field_presence": (_select(parsed, "record_index", "field_present['ERET'] AS eret", "field_present['PAIR'] AS pair", "field_raw['CELL'] AS raw_cell"), _BASE + "SELECT i AS record_index, i % 307 <> 0 OR i % 7 = 0 AS eret, TRUE AS pair, cell AS raw_cell FROM rec"),
    "dedupe_keep_max": (_select(records, "record_index", "pair", where="retained"), _BASE + "SELECT i AS record_index, pair FROM ded WHERE retained"),
    "dedupe_conflicts": (
        _select(records, "record_index", "is_duplicate_dropped", "is_snapshot_conflict", "get(filter(warnings, x -> x like 'snapshot%'), 0) AS message", where="is_duplicate_dropped or is_snapshot_conflict"),
        _BASE + f"SELECT i AS record_index, is_duplicate_dropped, is_snapshot_conflict, {_SNAPSHOT} AS message FROM ded WHERE is_duplicate_dropped OR is_snapshot_conflict",
    ),
    "dedupe_before_validate": (_select(records, "record_index", "sym", "cell", "cohort", where="retained and not valid"), _BASE + "SELECT i AS record_index, sym, cell, cohort FROM val WHERE retained AND NOT valid"),
    "validate_arith": (_select(records, "record_index", "ret_delta_ok", "mfe_delta_ok", "mae_delta_ok"), _BASE + "SELECT i AS record_index, ret_delta_ok, mfe_delta_ok, mae_delta_ok FROM val"),
    "validate_range": (_select(records, "record_index", "ehit", "get(filter(warnings, x -> x like '%outside%'), 0) AS message", where="ehit > 100 and parse_ok"), _BASE + "SELECT i AS record_index, round(ehit, 6) AS ehit, 'EHIT=150.0 outside expected range [0,100]' AS message FROM val WHERE ehit > 100 AND parse_ok"),
    "validate_missing": (_select(records, "record_index", "valid", where="exists(warnings, x -> x = 'ERET missing for a PAIR>0 record')"), _BASE + "SELECT i AS record_index, FALSE AS valid FROM val WHERE i % 307 = 0 AND pair > 0 AND parse_ok"),
    "derive_delta_signs": (_select(records, "record_index", "delta_hit", "dret_sign", "dmfe_sign", "dmae_sign"), _BASE + f"SELECT i AS record_index, {_r('delta_hit')}, dret_sign, dmfe_sign, dmae_sign FROM val"),
    "eligible_records": (_select(eligible, *S.ELIGIBLE_COLUMNS), _BASE + "SELECT " + ", ".join(_r(c) if c in S.WEIGHTED else c for c in S.ELIGIBLE_COLUMNS) + " FROM elig"),
    "audit_records": (
        lambda s, d: O.audit(records(s, d)),
        _BASE + f"SELECT i AS record_index, 'orders' AS source_file, sym, asset_class, cohort, cell, pair, parse_ok, valid, retained, retained AND valid AS eligible, is_duplicate_dropped, is_snapshot_conflict, ret_delta_ok, mfe_delta_ok, mae_delta_ok, CASE WHEN parse_ok THEN '' ELSE 'CMAE is not numeric or NA: ''n/a?''' END AS parse_errors, {_WARNINGS} AS warnings, {_RAW} AS raw_text FROM val",
    ),
    "integrity_counters": (
        _integrity,
        _BASE + """SELECT count(*) AS records_discovered, count(*) FILTER (retained AND valid) AS records_retained, count(*) FILTER (NOT valid) AS records_invalid, count(*) FILTER (is_duplicate_dropped) AS snapshot_duplicates, count(*) FILTER (is_snapshot_conflict) AS snapshot_conflicts,
          (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT cohort AS x FROM elig)) AS cohorts, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT sym AS x FROM elig)) AS markets, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT asset_class AS x FROM elig)) AS asset_classes,
          CAST(coalesce(sum(pair) FILTER (retained AND valid), 0) AS BIGINT) AS pair_total FROM val""",
    ),
    "weighted_means_cohort": (lambda s, d: rounded(O.weighted_means(eligible(s, d), "cohort")), _from_levels('SELECT "GROUP" AS cohort, ' + ", ".join(f"PAIR_WEIGHTED_{m.upper()}" for m in S.WEIGHTED) + " FROM lv WHERE GROUP_LEVEL = 'COHORT'")),
    "market_facts": (_market_facts, _BASE + "SELECT sym, CAST(sum(pair) AS BIGINT) AS pairs, " + ", ".join(f"round(sum({m} * pair) FILTER (pair > 0 AND {m} IS NOT NULL) / sum(pair) FILTER (pair > 0 AND {m} IS NOT NULL), 6) AS {m}" for m in S.CONSISTENCY) + " FROM elig GROUP BY sym"),
    "market_consistency": (partial(_of_levels, [c for c in S.SUMMARY_COLUMNS if "MARKET" in c and c.split("_")[0] in ("POS", "NEG", "ZERO", "DRET", "MEDIAN", "MIN", "MAX")]), _from_levels('SELECT GROUP_LEVEL, "GROUP", ' + ", ".join(c for c in S.SUMMARY_COLUMNS if "MARKET" in c and c.split("_")[0] in ("POS", "NEG", "ZERO", "DRET", "MEDIAN", "MIN", "MAX")) + " FROM lv")),
    "concentration": (partial(_of_levels, ["PAIR_SHARE_MAX_MARKET", "PAIR_SHARE_MAX_CLASS", "MARKET_CONCENTRATED", "CLASS_CONCENTRATED"]), _from_levels('SELECT GROUP_LEVEL, "GROUP", PAIR_SHARE_MAX_MARKET, PAIR_SHARE_MAX_CLASS, MARKET_CONCENTRATED, CLASS_CONCENTRATED FROM lv')),
    "labels": (partial(_of_levels, ["PAIR_TOTAL", "MARKETS", "MATURITY", "BREADTH", "MATCH_COVERAGE"]), _from_levels('SELECT GROUP_LEVEL, "GROUP", PAIR_TOTAL, MARKETS, MATURITY, BREADTH, MATCH_COVERAGE FROM lv')),
    "classification": (partial(_of_levels, ["CLASSIFICATION"]), _from_levels('SELECT GROUP_LEVEL, "GROUP", CLASSIFICATION FROM lv')),
    **{f"{name}_summary": (partial(_summary, level), _BASE + _level(level, extra=_OWN[level])) for name, level in (("cell", "CELL"), ("side_source", "SIDE_SOURCE"), ("source", "SOURCE"), ("side", "SIDE"), ("asset_class", "ASSET_CLASS"), ("market", "MARKET"), ("overall", "COHORT"))},
    "pooled_cohort": (lambda s, d: _summary("COHORT", s, d).orderBy("GROUP").limit(1), _BASE + f"SELECT * FROM ({_level('COHORT', extra=_OWN['COHORT'])}) ORDER BY COHORT LIMIT 1"),
    "all_levels": (_all, _ALL),
    "event_markets": (_events, _EVENTS + _level("MARKET", extra=_OWN["MARKET"])),
    "matrix_dret": (partial(_matrix, 0), _BASE + f"SELECT sym AS MARKET, {_MATRIX_SQL[0]} FROM elig GROUP BY sym"),
    "matrix_pair": (partial(_matrix, 1), _BASE + f"SELECT sym AS MARKET, {_MATRIX_SQL[1]} FROM elig GROUP BY sym"),
    "sort_cells": (_sort_cells, _from_levels(f"""SELECT g AS "GROUP", PAIR_TOTAL, row_number() OVER (ORDER BY PAIR_TOTAL DESC, {_ORDER_CELL}) AS place FROM (SELECT "GROUP" AS g, PAIR_TOTAL FROM lv WHERE GROUP_LEVEL = 'CELL')""")),
    "top_cells": (
        _top_cells,
        _from_levels(f""", seen AS (SELECT "GROUP" AS g, MARKETS, PAIR_WEIGHTED_DRET AS w FROM lv WHERE GROUP_LEVEL = 'CELL' AND PAIR_TOTAL > 0)
          SELECT (SELECT g FROM seen ORDER BY MARKETS DESC, {_ORDER_CELL} LIMIT 1) AS broadest, (SELECT g FROM seen WHERE w > 0 ORDER BY w DESC, {_ORDER_CELL} LIMIT 1) AS positive, (SELECT max(w) FROM seen WHERE w > 0) AS positive_dret,
            (SELECT g FROM seen WHERE w < 0 ORDER BY w, {_ORDER_CELL} LIMIT 1) AS negative, (SELECT min(w) FROM seen WHERE w < 0) AS negative_dret"""),
    ),
    "side_source_union": (_union, _from_levels("""SELECT "GROUP", PAIR_TOTAL, MARKETS, CLASSIFICATION, CASE WHEN "GROUP" LIKE 'B\\_%' ESCAPE '\\' OR "GROUP" = 'BUY' THEN 'BUY' WHEN "GROUP" LIKE 'S\\_%' ESCAPE '\\' OR "GROUP" = 'SELL' THEN 'SELL' END AS SIDE,
          CASE WHEN "GROUP" LIKE '%BAND' THEN 'BAND' WHEN "GROUP" LIKE '%DIV' THEN 'DIV' END AS SOURCE FROM lv WHERE GROUP_LEVEL IN ('SIDE_SOURCE', 'SOURCE', 'SIDE')""")),
    "verdict": (lambda s, d: _checkpoints(s, d).select("checkpoint", "classification", "research_verdict"), _from_levels(f"SELECT checkpoint, classification, research_verdict FROM ({_CHECKPOINTS})")),
    "asset_class_direction": (lambda s, d: rounded(O.class_direction(eligible(s, d))), _BASE + f"SELECT asset_class, CAST(sum(pair) AS BIGINT) AS pair_total, round({_CELL_SQL['w']}, 6) AS weighted_dret, CASE WHEN {_CELL_SQL['w']} > 1e-9 THEN 1 WHEN {_CELL_SQL['w']} < -1e-9 THEN -1 ELSE 0 END AS sign FROM elig GROUP BY asset_class"),
    "ledger_append": (_ledger, _from_levels(_LEDGER)),
    "ledger_trend_filter": (_trend, _from_levels("""SELECT "GROUP" AS "group", PAIR_TOTAL AS pairs, MARKETS AS markets, PAIR_WEIGHTED_DRET AS dret, CLASSIFICATION AS classification FROM lv WHERE GROUP_LEVEL IN ('SIDE_SOURCE', 'SOURCE')""")),
    "ledger_latest": (lambda s, d: latest(_ledger(s, d), "position"), _from_levels(f"SELECT * FROM ({_LEDGER}) ORDER BY position DESC LIMIT 1")),
    "content_hash": (_hashes, "SELECT n_nationkey || '.txt' AS file, sha256(n_name) AS sha256 FROM nation"),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.replace(", 6) AS", f" + {NUDGE}, 6) AS") for name, (_, sql) in CATALOGUE.items() if sql}
