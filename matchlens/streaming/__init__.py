"""Records as a stream: the largest snapshot of each cell so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions.text import normalize_newlines
from matchlens.operators import derive, parse_records, validate


def read_lines(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of the records in files that arrive in *directory*, as blocks, on one line or on several.

    Streams have no order over files: record_index is the time at which a file was written,
    in microseconds, and one more for each record of it."""
    files = spark.readStream.option("wholetext", True).text(directory)
    written = F.unix_micros(F.col("_metadata.file_modification_time"))
    parts = files.select(F.col("_metadata.file_path").alias("source_file"), written.alias("_at"), F.posexplode(F.split(normalize_newlines(F.col("value")), S.MARKER)).alias("pos", "rest")).where("pos > 0")
    return parts.select((F.col("_at") + F.col("pos") - 1).alias("record_index"), "source_file", F.concat(F.lit(S.MARKER), "rest").alias("block"))


def latest_snapshots(blocks: DataFrame) -> DataFrame:
    """The retained record of each cell so far; for output mode ``update`` or ``complete``.

    State is one record per cell, however often cells are exported again, so no watermark
    is needed; a late smaller snapshot changes nothing."""
    records = derive(validate(parse_records(blocks).where("parse_ok")))
    order = F.struct("pair", "record_index")
    rest = [c for c in records.columns if c not in S.KEY]
    return records.groupBy(*S.KEY).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*S.KEY, "r.*")
