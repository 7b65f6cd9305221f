"""Market by cell matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S


def _pivot(df: DataFrame, value: F.Column) -> DataFrame:
    return df.where("sym is not null").groupBy(F.col("sym").alias("MARKET")).pivot("cell", list(S.CELLS)).agg(value)


def market_cell_matrices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weighted DRET, PAIR sums) of eligible records: a row per market, a column per canonical cell.

    DRET is null where a cell has no pairs, PAIR 0; a market with other cells only still has a row."""
    use = F.col("dret").isNotNull() & ~F.isnan("dret") & (F.col("pair") > 0)
    weight = F.sum(F.when(use, F.col("pair")))
    dret = _pivot(df, F.sum(F.when(use, F.col("dret") * F.col("pair"))) / weight)
    return dret, _pivot(df, F.sum("pair")).na.fill(0, list(S.CELLS))
