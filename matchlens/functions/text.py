"""Strings and numbers as the record format reads and prints them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: Unicode spaces and the four separators U+001C-U+001F.
SPACE = r"[\s\x1c-\x1f]"
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_INTEGER = rf"^[+-]?{_DIGITS}$"
_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
_NAMED = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def decode(content: Column) -> Column:
    """UTF-8, invalid bytes as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def to_double(c: Column) -> Column:
    """A decimal literal (underscores between digits allowed), inf or nan; else null."""
    plain = F.translate(c, "_", "")
    named = F.regexp_replace(F.lower(plain), r"^[+-](?=nan)", "")
    return F.when(c.rlike(_FLOAT), plain.try_cast("double")).when(c.rlike(_NAMED), named.try_cast("double"))


def to_integer(c: Column) -> Column:
    """An integer literal, or a decimal one without a fraction; null otherwise, and beyond 64 bits."""
    number = to_double(c)
    whole = ~F.isnan(number) & (F.abs(number) < 9.2e18) & (number == F.floor(number))
    return F.when(c.rlike(_INTEGER), F.translate(c, "_", "").try_cast("bigint")).when(whole, number.try_cast("bigint"))


def shown(v: Column) -> Column:
    """A double in shortest form: plain from 1e-4 to 1e16, else with an exponent of two digits at least."""
    s = F.abs(v).cast("string")
    parts = r"^([0-9]+)\.([0-9]+)E(-?[0-9]+)$"
    head, tail, power = (F.regexp_extract(s, parts, i) for i in (1, 2, 3))
    tail = F.when(tail == "0", F.lit("")).otherwise(tail)
    e = power.try_cast("int")
    digits = F.concat(head, tail)
    large = F.when(F.length(tail) <= e, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mantissa = F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))
    exponent = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    exponent = F.when(F.abs(e) >= 100, F.concat(F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(exponent)
    body = F.when(~s.rlike(parts), s).when((F.abs(v) >= 1e16) | (F.abs(v) < 1e-4), F.concat(mantissa, F.lit("e"), exponent)).when(e > 0, large).otherwise(small)
    body = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), "inf").otherwise(body)
    return F.concat(F.when((v < 0) & ~F.isnan(v), "-").otherwise(""), body)
