"""Operation logs over plain tables: (k, v, flag, val), flag 1 marking a deletion.

The version is always a bare column of the table, so that a snapshot's predicate
is pushed down to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUE, DELETION = 0, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many versions of each user; an error event deletes the user's record."""
    t = table(spark, sf_dir, "events")
    return t.select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.when(F.col("event_type") == "error", DELETION).otherwise(VALUE).alias("flag"), F.col("value").alias("val"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version of each order, under a zero-padded text key; pending orders are deletions."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("k"), F.col("o_orderkey").alias("v"), F.when(F.col("o_orderstatus") == "P", DELETION).otherwise(VALUE).alias("flag"), F.col("o_totalprice").alias("val"))


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return t.select(F.col("c_name").alias("k"), F.col("c_custkey").alias("v"), F.lit(VALUE).alias("flag"), F.col("c_acctbal").alias("val"))


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys, many versions: the names of parts."""
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_name").alias("k"), F.col("p_partkey").alias("v"), F.lit(VALUE).alias("flag"), F.col("p_brand").alias("val"))


def runs(log: DataFrame, size: int = 500, levels: int = 4, record: int = 64) -> DataFrame:
    """Sorted-run metadata of a log cut by version: level, number, smallest, largest, size, ctime."""
    number = F.floor(F.col("v") / size)
    return log.groupBy(number.alias("number")).agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), (F.count("*") * record).alias("size"), F.max("v").alias("ctime")).select((F.col("number") % levels).cast("int").alias("level"), "number", "smallest", "largest", "size", "ctime")


def batches(log: DataFrame, size: int = 10) -> DataFrame:
    """The log regrouped as write batches: batch_id and ops, an array of (pos, op, key, value)."""
    op = F.struct((F.col("v") % size).cast("int").alias("pos"), F.col("flag").alias("op"), F.col("k").alias("key"), F.col("val").alias("value"))
    return log.groupBy(F.floor(F.col("v") / size).alias("batch_id")).agg(F.array_sort(F.collect_list(op)).alias("ops"))
