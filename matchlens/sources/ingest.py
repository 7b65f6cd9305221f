"""Record blocks from log files, directories and standard input."""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions.text import decode, normalize_newlines

STDIN = "-"
STDIN_LABEL = "<stdin>"
#: Ordinals of inputs whose counts of blocks are summed together.
RANGE = 1 << 16
#: Bytes from which on a file is split among tasks.
LARGE_FILE = 64 << 20


def list_inputs(paths: Iterable[str]) -> list[str]:
    """Files to read, in order: a directory stands for its .txt, .log and .csv files by
    path (not those of its directories), ``-`` for standard input; any file may be named."""
    out: list[str] = []
    for p in paths:
        if p == STDIN:
            out.append(p)
        elif os.path.isdir(p):
            found = [x for x in Path(p).iterdir() if x.name.endswith(S.READABLE)]
            out += [str(x) for x in sorted(found)]
        elif os.path.isfile(p):
            out.append(str(Path(p)))
        else:
            raise FileNotFoundError(f"input path not found: {p}")
    return out


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(files: Iterable[str], stdin: bytes = b"") -> dict[str, str]:
    """sha256 of every input's bytes, empty files included (Spark's scan returns none of them)."""
    return {STDIN_LABEL if f == STDIN else f: hashlib.sha256(stdin).hexdigest() if f == STDIN else _sha256(f) for f in files}


def _own_reading(path: str) -> bool:
    """Whether Spark's scan would skip the file or take its name for a pattern."""
    return os.path.basename(path).startswith((".", "_")) or bool(re.search(r"[*?\[\]{}\\]", path))


def _parts(inputs: DataFrame) -> DataFrame:
    """What follows each marker in (ordinal, source_file, content): with _start 0 and the _rank in the input."""
    text = normalize_newlines(decode(F.col("content")))
    parts = inputs.select("ordinal", "source_file", F.lit(0).cast("long").alias("_start"), F.posexplode(F.split(text, S.MARKER)).alias("_rank", "rest"))
    return parts.where("_rank > 0").withColumn("_rank", F.col("_rank").cast("long") - 1)


def _numbered(parts: DataFrame) -> DataFrame:
    """Blocks from *parts* (ordinal, source_file, _start of a piece of the input, _rank in it, rest).

    record_index numbers them over all inputs in their order.  The offsets are sums over
    ranges of RANGE ordinals and then within each, so that no window spans all inputs.
    """
    piece = ["ordinal", "_start"]
    counts = parts.groupBy(*piece).agg(F.count("*").alias("n")).withColumn("_range", F.floor(F.col("ordinal") / RANGE))

    def above(w: Window) -> F.Column:
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = counts.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", above(Window.orderBy("_range")).alias("_base"))
    own = counts.select(*piece, "_range", above(Window.partitionBy("_range").orderBy(*piece)).alias("_before")).join(ranges, "_range")
    index = F.col("_base") + F.col("_before") + F.col("_rank")
    return parts.join(own, piece).select(index.alias("record_index"), "source_file", F.concat(F.lit(S.MARKER), F.col("rest")).alias("block"))


def split_blocks(inputs: DataFrame) -> DataFrame:
    """Blocks of (ordinal, source_file, content): text from one marker up to the next."""
    return _numbered(_parts(inputs))


def _large_parts(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """As _parts(), for files that many tasks read: the scan itself splits at the markers.

    Rows of one split of a file have consecutive ids, so the least of them gives ranks."""
    order = spark.createDataFrame([(i, f, os.path.abspath(f)) for i, f in files], "ordinal long, source_file string, _path string")
    read = spark.read.option("lineSep", S.MARKER).text([f"file://{os.path.abspath(f)}" for f in dict.fromkeys(f for _, f in files)])
    read = read.select(
        F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), normalize_newlines(decode(F.col("value").cast("binary"))).alias("rest"),
    )
    least = read.groupBy("_path", "_start").agg(F.min("_id").alias("_least"))
    # What comes before the first marker of a file is no block.
    rank = F.col("_id") - F.col("_least") - (F.col("_start") == 0).cast("long")
    parts = read.join(least, ["_path", "_start"]).withColumn("_rank", rank).where("_rank >= 0").join(order, "_path").select("ordinal", "source_file", "_start", "_rank", "rest")
    # The scan has no empty row behind a marker that ends a file.
    ends = [(i, f, os.path.getsize(f), 0, "") for i, f in files if _tail(f) == S.MARKER.encode()]
    return parts.unionByName(spark.createDataFrame(ends, "ordinal long, source_file string, _start long, _rank long, rest string"))


def _tail(path: str) -> bytes:
    with open(path, "rb") as f:
        f.seek(-len(S.MARKER), os.SEEK_END)
        return f.read()


def read_blocks(spark: SparkSession, paths: Iterable[str], stdin: bytes | None = None) -> DataFrame:
    """(record_index, source_file, block) of all inputs; a path given twice is read twice.

    Files of LARGE_FILE bytes or more are read by many tasks, others by one each."""
    files = list_inputs(paths)
    if STDIN in files and stdin is None:
        stdin = sys.stdin.buffer.read()
    scanned = [f for f in dict.fromkeys(files) if f != STDIN and not _own_reading(f) and os.path.getsize(f)]
    large = [(i, f) for i, f in enumerate(files) if f in scanned and os.path.getsize(f) >= LARGE_FILE]
    small = [f for f in scanned if os.path.getsize(f) < LARGE_FILE]
    held = [(i, STDIN_LABEL if f == STDIN else f, bytearray(stdin if f == STDIN else Path(f).read_bytes())) for i, f in enumerate(files) if f not in scanned]
    out = spark.createDataFrame(held, "ordinal long, source_file string, content binary")
    if small:
        order = spark.createDataFrame([(i, f, os.path.abspath(f)) for i, f in enumerate(files) if f in small], "ordinal long, source_file string, _path string")
        read = spark.read.format("binaryFile").load([f"file://{os.path.abspath(f)}" for f in small])
        read = read.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), "content")
        seen = {r[0] for r in read.select("_path").collect()}
        if lost := sorted({os.path.abspath(f) for f in small} - seen):
            raise OSError(f"inputs that the scan did not return: {', '.join(lost)}")
        out = out.unionByName(read.join(order, "_path").select("ordinal", "source_file", "content"))
    parts = _parts(out)
    return _numbered(parts.unionByName(_large_parts(spark, large)) if large else parts)


def blocks_from_text(texts: DataFrame) -> DataFrame:
    """Blocks of a table (ordinal, source_file, text), e.g. log lines in a column."""
    return split_blocks(texts.select("ordinal", "source_file", F.col("text").cast("binary").alias("content")))
