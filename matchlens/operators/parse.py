"""Records from text blocks: tokens, fields, typed values and parse errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions.text import SPACE, strip, to_double, to_integer

_TOKEN = rf"(?U)\|{SPACE}*([A-Za-z_]+){SPACE}*={SPACE}*([^|\r\n]*)"
_CELL = r"(?U)^([BS])_(BAND|DIV)_(T\d{2}-\d{2})$"


def tokens(block: Column) -> Column:
    """The KEY=VALUE tokens of a block, in order: keys in upper case, values stripped."""
    whole = F.regexp_extract_all(block, F.lit(_TOKEN), F.lit(0))

    def cut(token: Column) -> Column:
        at = F.instr(token, F.lit("="))
        return F.struct(F.upper(strip(F.substr(token, F.lit(2), at - 2))).alias("k"), strip(F.substr(token, at + 1)).alias("v"))

    return F.transform(whole, cut)


def field(keys: Column, values: Column, key: str) -> Column:
    """The value of the last token named *key* (null if there is none); *keys* and *values* run from the last to the first."""
    return F.get(values, F.array_position(keys, F.lit(key)).cast("int") - 1)


def split_cell(cell: Column) -> dict[str, Column]:
    """side, source and age_bucket of a well-formed cell; null otherwise."""
    code = F.regexp_extract(cell, _CELL, 1)
    good = cell.rlike(_CELL)
    return {
        "side": F.when(good, F.when(code == "B", S.SIDES["B"]).otherwise(S.SIDES["S"])),
        "source": F.when(good, F.regexp_extract(cell, _CELL, 2)),
        "age_bucket": F.when(good, F.regexp_extract(cell, _CELL, 3)),
    }


def barrier(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns, computed once per row: neither projections nor filters above are merged
    into them (a filter on a parsed value would otherwise parse anew for each mention)."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _errors() -> Column:
    """Messages in the order identities, PAIR, CELL pattern, metrics."""
    found = [F.when(_missing(F.col(f"_{k}")), f"missing required field {k}") for k in S.IDENTITY]
    pair, cell = F.col("_PAIR"), F.col("_CELL")
    found.append(
        F.when(_missing(pair), "missing required field PAIR")
        .when(F.col("_number").isNull(), F.concat(F.lit("PAIR is not a valid integer: '"), pair, F.lit("'")))
        .when(F.col("_number") < 0, F.concat(F.lit("PAIR is negative: "), F.col("_number").cast("string")))
    )
    found.append(F.when(~_missing(cell) & ~cell.rlike(_CELL), F.concat(F.lit("CELL '"), cell, F.lit("' does not match an expected pattern (e.g. B_BAND_T01-05)"))))
    for m in S.METRICS:
        raw = F.col(f"_{m}")
        bad = ~_missing(raw) & (F.upper(raw) != "NA") & F.col(m.lower()).isNull()
        found.append(F.when(bad, F.concat(F.lit(f"{m} is not numeric or NA: '"), raw, F.lit("'"))))
    return F.array_compact(F.array(*found))


def parse_records(blocks: DataFrame) -> DataFrame:
    """One record per block (record_index, source_file, block); narrow, without a shuffle.

    A field that occurs twice has its last value; NA counts as present and null.  Records
    with errors keep what could be read, with parse_ok false.
    """
    found = barrier(blocks, F.col("record_index"), F.col("source_file"), F.col("block"), F.reverse(tokens(F.col("block"))).alias("_tokens"))
    # Keys and values are taken out of the tokens once, not for each field.
    cut = barrier(found, F.col("record_index"), F.col("source_file"), strip(F.col("block")).alias("raw_text"), F.col("_tokens.k").alias("_keys"), F.col("_tokens.v").alias("_values"))
    raw = barrier(cut, F.col("record_index"), F.col("source_file"), F.col("raw_text"), *(field(F.col("_keys"), F.col("_values"), k).alias(f"_{k}") for k in S.FIELDS))
    values = [F.when(F.upper(F.col(f"_{m}")) != "NA", to_double(F.col(f"_{m}"))).alias(m.lower()) for m in S.METRICS]
    typed = barrier(raw, *map(F.col, raw.columns), to_integer(F.col("_PAIR")).alias("_number"), *values)
    checked = barrier(typed, *map(F.col, typed.columns), _errors().alias("parse_errors"))
    names = {"sym": "_SYM", "asset_class": "_CLASS", "cohort": "_COHORT", "cell": "_CELL"}
    identity = [F.when(~_missing(F.col(c)), F.col(c)).alias(name) for name, c in names.items()]
    parts = [c.alias(name) for name, c in split_cell(F.col("_CELL")).items()]
    keys = F.array(*map(F.lit, S.FIELDS))
    return checked.select(
        "record_index", "source_file", "raw_text", *identity, *parts,
        F.when(F.col("_number") >= 0, F.col("_number")).alias("pair"), *S.METRIC_COLUMNS,
        F.map_from_arrays(keys, F.array(*(~_missing(F.col(f"_{k}")) for k in S.FIELDS))).alias("field_present"),
        F.map_from_arrays(keys, F.array(*(F.col(f"_{k}") for k in S.FIELDS))).alias("field_raw"),
        (F.size("parse_errors") == 0).alias("parse_ok"), "parse_errors", (F.size("parse_errors") == 0).alias("valid"), F.col("parse_errors").alias("warnings"),
    )
