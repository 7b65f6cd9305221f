"""Small files written by the driver: CSV in one fixed dialect, Markdown, JSON.

The dialect: comma, minimal quoting with doubled quotes, LF line ends, empty for null,
True/False, shortest decimals.  Rows are streamed, so a table needs no driver memory.
"""

from __future__ import annotations

import csv
import math
import os
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions.text import shown as to_text


def write_atomic(path: Path, write: Callable) -> None:
    """A reader sees the old file or the whole new one."""
    part = path.with_name(f".{path.name}.part")
    with part.open("w", encoding="utf-8", newline="") as f:
        write(f)
    os.replace(part, path)


def write_text(path: Path, text: str) -> None:
    write_atomic(path, lambda f: f.write(text))


def _cell(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v) if isinstance(v, float) else v


def write_rows(path: Path, columns: Iterable[str], rows: Iterable[Iterable]) -> None:
    def write(f) -> None:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(columns)
        out.writerows([_cell(v) for v in row] for row in rows)

    write_atomic(path, write)


def write_frame(path: Path, df: DataFrame, as_float: Iterable[str] = ()) -> None:
    """*df* in its order; integers of *as_float* columns are written as decimals."""
    to = {df.columns.index(c) for c in as_float}
    rows = ([float(v) if i in to and v is not None else v for i, v in enumerate(r)] for r in df.toLocalIterator(prefetchPartitions=True))
    write_rows(path, df.columns, rows)


def write_large(path: Path, df: DataFrame, order: str, as_float: Iterable[str] = ()) -> None:
    """*df* in the order of a column as a directory of CSV parts in the same dialect, written by the executors.

    Each part has the header; their names are in order.  On a cluster *path* must be shared."""
    columns = []
    for c, kind in df.dtypes:
        v = F.col(f"`{c}`").cast("double") if c in as_float else F.col(f"`{c}`")
        v = F.initcap(v.cast("string")) if kind == "boolean" else to_text(v) if kind == "double" or c in as_float else v
        columns.append(v.alias(c))
    ordered = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(*columns)
    ordered.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "").csv(path.absolute().as_uri())


def shown(v: object, form: str = "") -> str:
    """A value for reading: *form* is a number of decimals, ``%`` for a share, or empty."""
    if v is None or v != v:
        return "NA"
    return f"{v:.1%}" if form == "%" else f"{float(v):.{form}f}" if form else str(v)


def table(columns: Iterable[tuple[str, str, str]], rows: Iterable[dict]) -> list[str]:
    """Lines of a Markdown table: *columns* have a heading, the key of their value, and its form."""
    columns = list(columns)
    lines = [[head for head, _, _ in columns], ["---"] * len(columns), *([shown(r.get(key), form) for _, key, form in columns] for r in rows)]
    return [*(f"| {' | '.join(x)} |" for x in lines), ""]
