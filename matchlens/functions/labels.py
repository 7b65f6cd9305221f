"""Descriptive labels.  None of them states or implies statistical inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens import schema as S


def sign(v: Column, epsilon: float = S.SIGN_EPSILON) -> Column:
    """1, -1 or 0; null and NaN are 0 (NaN would otherwise count as greater than all)."""
    ok = v.isNotNull() & ~F.isnan(v)
    return F.when(ok & (v > epsilon), 1).when(ok & (v < -epsilon), -1).otherwise(0)


def maturity(pairs: Column) -> Column:
    out = F.lit(S.MATURITY[-1][1])
    for limit, name in reversed(S.MATURITY[:-1]):
        out = F.when(pairs < limit, name).otherwise(out)
    return out


def breadth(markets: Column) -> Column:
    out = F.lit(S.BREADTH[-1][1])
    for limit, name in reversed(S.BREADTH[:-1]):
        out = F.when(markets <= limit, name).otherwise(out)
    return out


def classification(pairs: Column, markets: Column, weighted_dret: Column, pos_share: Column, neg: Column) -> Column:
    """The evidence label.  The positive share is of markets with a defined mean, the
    negative one of all markets with pairs."""
    up, down = F.coalesce(pos_share, F.lit(0.0)), F.when(markets > 0, neg / markets).otherwise(0.0)
    wide = (pairs >= S.CROSS_MARKET_PAIRS) & (markets >= S.CROSS_MARKET_MARKETS)
    return (
        F.when((pairs < S.LEAST_PAIRS) | (markets < S.LEAST_MARKETS), "INSUFFICIENT")
        .when(wide & (weighted_dret > 0) & (up >= S.SHARE), "CROSS_MARKET_POS")
        .when(wide & (weighted_dret < 0) & (down >= S.SHARE), "CROSS_MARKET_NEG")
        .when((weighted_dret > 0) & (up > S.SHARE), "EARLY_CONSISTENT_POS")
        .when((weighted_dret < 0) & (down > S.SHARE), "EARLY_CONSISTENT_NEG")
        .otherwise("EARLY_MIXED")
    )


def verdict(label: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in S.VERDICTS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, label), F.lit(S.DEFAULT_VERDICT))
