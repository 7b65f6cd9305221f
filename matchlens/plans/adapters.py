"""Driver tables as record inputs: orders with their customer's nation and region, and events.

Every value is arithmetic on keys, so that an independent SQL text can say the same: all
16 cells and some non-canonical ages occur, PAIR ties and repeats give duplicates and
conflicts, some deltas don't reconcile, some hit rates are out of range, some fields are
missing, and PAIR=0 records have NA metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens import schema as S
from matchlens.functions.text import normalize_newlines

#: Metrics in thousandths, from the record's key i.
_ORDERS = {
    "ERET": "i * 37 % 2001 - 1000", "CRET": "i * 53 % 1501 - 700", "DRET": "(i * 37 % 2001 - 1000) - (i * 53 % 1501 - 700) + IF(i % 17 = 0, 5, 0)",
    "EHIT": "IF(i % 211 = 0, 150, i % 101) * 1000", "CHIT": "i * 7 % 101 * 1000",
    "EMFE": "i * 29 % 1800", "CMFE": "i * 31 % 1600", "DMFE": "i * 29 % 1800 - i * 31 % 1600 + IF(i % 19 = 0, 7, 0)",
    "EMAE": "-(i * 23 % 1700)", "CMAE": "-(i * 41 % 1900)", "DMAE": "-(i * 23 % 1700) + i * 41 % 1900",
}


def _decimal(thousandths: Column) -> Column:
    a = F.abs(thousandths)
    return F.concat(F.when(thousandths < 0, "-").otherwise(""), F.floor(a / 1000).cast("string"), F.lit("."), F.lpad((a % 1000).cast("string"), 3, "0"))


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: i, the identity fields, and every value as text (null: absent)."""
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("orders", "customer", "nation", "region")}
    # nation and region have 25 and 5 rows by definition.
    place = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t["orders"].join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    age = F.when(F.expr("o_orderkey % 97 = 0"), "T21-25")
    for k, name in enumerate(S.AGES):
        age = age.when(F.month("o_orderdate") % 4 == k, name)
    rows = rows.select(
        F.col("o_orderkey").cast("long").alias("i"), F.col("n_name").alias("SYM"), F.col("r_name").alias("CLASS"), F.concat(F.lit("C-"), "o_orderstatus").alias("COHORT"),
        F.concat_ws("_", F.expr("IF(o_orderkey % 2 = 0, 'B', 'S')"), F.expr("IF(o_custkey % 3 = 0, 'DIV', 'BAND')"), age).alias("CELL"),
        F.expr("o_orderkey % 7").cast("string").alias("PAIR"),
    )
    metrics = {m: F.when(F.expr("i % 7 = 0"), "NA").otherwise(_decimal(F.expr(e))) for m, e in _ORDERS.items()}
    metrics["ERET"] = F.when(F.expr("i % 307 != 0 OR i % 7 = 0"), metrics["ERET"])
    metrics["CMAE"] = F.when(F.expr("i % 503 = 0"), "n/a?").otherwise(metrics["CMAE"])
    return rows.withColumns(metrics)


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as (i, text): half on one line, half a field a line with CRLF, between noise."""
    parts = F.concat_ws("|", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k))) for k in S.FIELDS))
    one = F.concat(F.lit("T44C|"), parts, F.lit("\n[log] bar closed\n"))
    many = F.concat(F.lit("T44C\r\n| pair = 999\r\n|"), F.regexp_replace(parts, r"\|", " \r\n| "), F.lit("\r\n\r\nplot | not=a|field=either\r\n"))
    return order_fields(spark, sf_dir).select("i", F.when(F.expr("i % 2 = 0"), one).otherwise(many).alias("text"))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as record blocks, by their keys."""
    return order_texts(spark, sf_dir).select(F.col("i").alias("record_index"), F.lit("orders").alias("source_file"), normalize_newlines(F.col("text")).alias("block"))


#: What is wrong with every fifth record of faulty_blocks(): the field and what stands in its place (null: nothing).
FAULTS = (("SYM", None), ("CELL", "B_BAND_XX"), ("PAIR", "-4"), ("PAIR", "4.5"), ("DRET", "1,5"))


def faulty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as record blocks of which each has one fault, by the remainder of its key."""
    rows = order_fields(spark, sf_dir).where("i % 7 <> 0 and i % 503 <> 0")
    for k, (name, value) in enumerate(FAULTS):
        rows = rows.withColumn(name, F.when(F.col("i") % len(FAULTS) == k, F.lit(value).cast("string")).otherwise(F.col(name)))
    parts = F.concat_ws("|", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k))) for k in S.FIELDS))
    return rows.select(F.col("i").alias("record_index"), F.lit("orders").alias("source_file"), F.concat(F.lit("T44C|"), parts).alias("block"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible records with many markets (the users) and one class per event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = e.select(
        F.col("event_id").cast("long").alias("record_index"), F.lit("events").alias("source_file"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sym"), F.col("event_type").alias("asset_class"), F.lit("C-E").alias("cohort"),
        F.expr("concat(IF(event_id % 2 = 0, 'B', 'S'), '_', IF(event_id % 3 = 0, 'DIV', 'BAND'), '_T01-05')").alias("cell"), F.expr("IF(event_id % 2 = 0, 'BUY', 'SELL')").alias("side"), F.expr("IF(event_id % 3 = 0, 'DIV', 'BAND')").alias("source"), F.lit("T01-05").alias("age_bucket"),
        F.expr("event_id % 5").cast("long").alias("pair"), *(F.expr(f"CAST((event_id * {13 + 2 * k} % 2001 - 1000) AS DOUBLE) / 1000").alias(m) for k, m in enumerate(S.METRIC_COLUMNS)),
    )
    return base.withColumn("delta_hit", F.col("ehit") - F.col("chit"))
