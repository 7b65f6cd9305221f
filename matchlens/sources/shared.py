"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out by this process, by the application they belong to.
_given: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names.

    Where it is unset a local session, as in tests, gets a temporary folder of this machine;
    on a cluster that would be another disk for each executor, so there it is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = found.get() if found.isDefined() else "file://" + tempfile.mkdtemp(prefix="matchlens-tables-")
        if not found.isDefined():
            sc.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/table-{uuid.uuid4().hex}"
    _given.setdefault(sc.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of *df* as a table in the shared folder: computed once however often it is
    read, and not lost with an executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application, and say how many there were.

    Call it when no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _given.pop(spark.sparkContext.applicationId, [])
    n = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
