"""Pair-weighted summaries of eligible records at seven levels, in one pass.

Weighted sums add up, so each record is dealt once to its group of every level and
summed by (level, group, market, class); that aggregate combines before its shuffle.  The
market and class profiles and the group totals are sums over those facts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions import labels


def _counts(m: str) -> Column:
    return F.col(m).isNotNull() & ~F.isnan(m) & (F.col("pair") > 0)


def _sums(metrics: Iterable[str]) -> list[Column]:
    out = []
    for m in metrics:
        out += [F.sum(F.when(_counts(m), F.col(m) * F.col("pair"))).alias(f"_w_{m}"), F.sum(F.when(_counts(m), F.col("pair"))).alias(f"_d_{m}")]
    return out


def _means(prefix: str = "") -> dict[str, Column]:
    return {m: F.sum(f"_w_{m}") / F.sum(f"_d_{m}") for m in S.WEIGHTED}


def weighted_means(df: DataFrame, *by: str) -> DataFrame:
    """Per group of *by*: each metric's mean weighted by pair, over its own non-null records with pairs."""
    return df.groupBy(*by).agg(*_sums(S.WEIGHTED)).select(*by, *((F.col(f"_w_{m}") / F.col(f"_d_{m}")).alias(f"PAIR_WEIGHTED_{m.upper()}") for m in S.WEIGHTED))


def _group_of(level: str) -> Column:
    code = F.when(F.col("side") == S.SIDES["B"], "B").when(F.col("side") == S.SIDES["S"], "S")
    return {
        "CELL": F.when(F.col("cell").isin(*S.CELLS), F.col("cell")), "SIDE_SOURCE": F.concat_ws("_", code, "source"), "SOURCE": F.col("source"),
        "SIDE": F.col("side"), "ASSET_CLASS": F.col("asset_class"), "MARKET": F.col("sym"), "COHORT": F.col("cohort"),
    }[level]


def market_facts(df: DataFrame, levels: Iterable[str] = S.LEVELS) -> DataFrame:
    """Sums of eligible records by (GROUP_LEVEL, GROUP, sym, asset_class)."""
    levels = list(levels)
    groups = F.array(*(F.struct(F.lit(x).alias("GROUP_LEVEL"), _group_of(x).alias("GROUP")) for x in levels))
    groups = F.filter(groups, lambda g: g["GROUP"].isNotNull() & (g["GROUP"] != ""))
    dealt = df.select("sym", "asset_class", "pair", "record_index", *S.WEIGHTED, F.explode(groups).alias("g"))
    return dealt.groupBy("g.GROUP_LEVEL", "g.GROUP", "sym", "asset_class").agg(F.sum("pair").alias("_pairs"), F.min("record_index").alias("_first"), *_sums(S.WEIGHTED))


def _markets(facts: DataFrame) -> DataFrame:
    """Per group: market profile and totals, from facts pooled over classes."""
    by = ["GROUP_LEVEL", "GROUP"]
    pooled = facts.groupBy(*by, "sym").agg(
        F.sum("_pairs").alias("_pairs"), F.min_by("asset_class", F.when(F.col("asset_class").isNotNull(), F.col("_first"))).alias("_class"),
        *(F.sum(f"_{k}_{m}").alias(f"_{k}_{m}") for m in S.WEIGHTED for k in "wd"),
        *((F.sum(f"_w_{m}") / F.sum(f"_d_{m}")).alias(f"_m_{m}") for m in S.CONSISTENCY),
    )
    own = F.col("sym").isNotNull()
    out = [
        F.count_if(own & (F.col("_pairs") > 0)).alias("MARKETS"), F.sum("_pairs").alias("PAIR_TOTAL"), F.max(F.when(own, F.col("_pairs"))).alias("_top_market"),
        F.min_by("_class", "sym").alias("_class"), *(c.alias(f"PAIR_WEIGHTED_{m.upper()}") for m, c in _means().items()),
    ]
    for m in S.CONSISTENCY:
        v = F.when(own, F.col(f"_m_{m}"))
        name = m.upper()
        out += [F.count_if(v > S.MARKET_EPSILON).alias(f"POS_{name}_MARKETS"), F.count_if(v < -S.MARKET_EPSILON).alias(f"NEG_{name}_MARKETS"), F.count(v).alias(f"_n_{m}"), F.median(v).alias(f"MEDIAN_MARKET_{name}")]
    out += [F.min(F.when(own, F.col("_m_dret"))).alias("MIN_MARKET_DRET"), F.max(F.when(own, F.col("_m_dret"))).alias("MAX_MARKET_DRET")]
    return pooled.groupBy(*by).agg(*out)


def _classes(facts: DataFrame) -> DataFrame:
    by = ["GROUP_LEVEL", "GROUP"]
    pooled = facts.where("asset_class is not null").groupBy(*by, "asset_class").agg(F.sum("_pairs").alias("_pairs"))
    return pooled.groupBy(*by).agg(F.count_if(F.col("_pairs") > 0).alias("ASSET_CLASSES"), F.max("_pairs").alias("_top_class"))


def _spine(df: DataFrame, levels: list[str]) -> DataFrame:
    """The groups that have a row even without records."""
    rows = [("CELL", c) for c in S.CELLS] + [("SIDE_SOURCE", f"{a}_{b}") for a in S.SIDES for b in S.SOURCES] + [("SOURCE", s) for s in S.SOURCES] + [("SIDE", s) for s in S.SIDES.values()]
    rows = [(level, group, i) for i, (level, group) in enumerate(rows) if level in levels]
    return df.sparkSession.createDataFrame(rows, "GROUP_LEVEL string, GROUP string, _order int")


def _finish(groups: DataFrame) -> DataFrame:
    zero = ["MARKETS", "ASSET_CLASSES", "PAIR_TOTAL", *(f"{x}_{m.upper()}_MARKETS" for x in ("POS", "NEG") for m in S.CONSISTENCY), "_n_dret"]
    filled = groups.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})

    def share(c: str) -> Column:
        return F.when(F.col("PAIR_TOTAL") > 0, F.coalesce(F.col(c) / F.col("PAIR_TOTAL"), F.lit(0.0))).otherwise(0.0)

    filled = filled.withColumns(
        {
            "N_MARKETS": F.col("MARKETS"), "ZERO_DRET_MARKETS": F.col("_n_dret") - F.col("POS_DRET_MARKETS") - F.col("NEG_DRET_MARKETS"),
            "DRET_POS_MARKET_SHARE": F.when(F.col("_n_dret") > 0, F.col("POS_DRET_MARKETS") / F.col("_n_dret")),
            "PAIR_SHARE_MAX_MARKET": share("_top_market"), "PAIR_SHARE_MAX_CLASS": share("_top_class"), "MATCH_COVERAGE": F.lit("NOT_AVAILABLE"),
            "MATURITY": labels.maturity(F.col("PAIR_TOTAL")), "BREADTH": labels.breadth(F.col("MARKETS")),
        }
    )
    filled = filled.withColumns(
        {
            "MARKET_CONCENTRATED": F.col("PAIR_SHARE_MAX_MARKET") > S.MARKET_CONCENTRATION, "CLASS_CONCENTRATED": F.col("PAIR_SHARE_MAX_CLASS") > S.CLASS_CONCENTRATION,
            "CLASSIFICATION": labels.classification(F.col("PAIR_TOTAL"), F.col("MARKETS"), F.col("PAIR_WEIGHTED_DRET"), F.col("DRET_POS_MARKET_SHARE"), F.col("NEG_DRET_MARKETS")),
        }
    )
    return filled.select(*S.SUMMARY_COLUMNS, "_class", "_order")


def summarize_all(df: DataFrame, levels: Iterable[str] = S.LEVELS) -> DataFrame:
    """The 42 summary columns for every group of *levels*, plus _class (of a market: the
    class it was first met with) and _order (place of a fixed group).

    Fixed groups (cells, sides, sources) have a row always, others if they have records;
    without records the COHORT level has one row, ``(no cohort)``.
    """
    levels = list(levels)
    facts = market_facts(df, levels)
    by = ["GROUP_LEVEL", "GROUP"]
    found = _markets(facts).join(_classes(facts), by, "left")
    fixed = _spine(df, levels)
    # At most 24 rows, the fixed groups.
    out = found.join(F.broadcast(fixed.select(*by, "_order")), by, "left")
    absent = fixed.join(found.select(*by), by, "left_anti")
    if "COHORT" in levels:
        none = df.agg(F.count("cohort").alias("n")).where("n = 0").select(F.lit("COHORT").alias("GROUP_LEVEL"), F.lit(S.NO_COHORT).alias("GROUP"), F.lit(None).cast("int").alias("_order"))
        absent = absent.unionByName(none)
    return _finish(out.unionByName(absent, allowMissingColumns=True))


def _own(level: str) -> dict[str, Column]:
    """The columns that the table of one level has besides the summary columns."""
    group, code = F.col("GROUP"), F.split("GROUP", "_")
    side = F.when(code[0] == "B", S.SIDES["B"]).otherwise(S.SIDES["S"])
    return {
        "CELL": {"CELL": group, "SIDE": side, "SOURCE": F.get(code, F.lit(1)), "AGE_BUCKET": F.get(code, F.lit(2))},
        "SIDE_SOURCE": {"SIDE": side, "SOURCE": F.get(code, F.lit(1))}, "SOURCE": {"SOURCE": group}, "SIDE": {"SIDE": group},
        "ASSET_CLASS": {"ASSET_CLASS": group}, "MARKET": {"SYM": group, "ASSET_CLASS": F.col("_class")},
        "COHORT": {"COHORT": F.when(group != S.NO_COHORT, group)},
    }[level]


def summarize(df: DataFrame, level: str) -> DataFrame:
    """The table of one level: the summary columns and then its own, in the level's order."""
    return summarize_all(df, [level]).orderBy("_order", "GROUP").select(*S.SUMMARY_COLUMNS, *(c.alias(name) for name, c in _own(level).items()))


def summarize_union(df: DataFrame, levels: Iterable[str], own: Iterable[str]) -> DataFrame:
    """The tables of *levels* one after the other, from one pass: the summary columns and
    the columns named *own*, null for levels that have none of that name."""
    levels = list(levels)
    columns = {x: _own(x) for x in levels}
    named = [F.coalesce(*(F.when(F.col("GROUP_LEVEL") == x, columns[x][name]) for x in levels if name in columns[x])).alias(name) for name in own]
    place = F.array_position(F.array(*map(F.lit, levels)), F.col("GROUP_LEVEL"))
    return summarize_all(df, levels).orderBy(place, "_order", "GROUP").select(*S.SUMMARY_COLUMNS, *named)


def class_direction(df: DataFrame) -> DataFrame:
    """Pair total, weighted DRET and its sign of every asset class."""
    sums = df.where("asset_class is not null").groupBy("asset_class").agg(F.sum("pair").alias("pair_total"), *_sums(["dret"]))
    mean = F.col("_w_dret") / F.col("_d_dret")
    return sums.select("asset_class", "pair_total", mean.alias("weighted_dret"), labels.sign(mean).alias("sign"))
