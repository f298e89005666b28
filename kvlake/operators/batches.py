"""Atomic write batches: versions, last write wins, memtable accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.operators.ordered import running_sum


def apply(batches: DataFrame, first_version: int = 0) -> DataFrame:
    """(k, v, flag, val) of all operations; versions follow batch order, then order in the batch. Empty batches add nothing."""
    sized = running_sum(batches.withColumn("n", F.size("ops").cast("long")), "n", "batch_id", name="upto")
    ops = sized.select((F.col("upto") - F.col("n") + first_version).alias("base"), F.posexplode("ops").alias("pos", "op"))
    return ops.select(F.col("op.key").alias("k"), (F.col("base") + F.col("pos")).cast("long").alias("v"), F.col("op.op").alias("flag"), F.col("op.value").alias("val"))


def last_of_batch(batches: DataFrame) -> DataFrame:
    """Of each batch and key the operation that wins."""
    ops = batches.select("batch_id", F.posexplode("ops").alias("pos", "op"))
    won = ops.groupBy("batch_id", F.col("op.key").alias("k")).agg(F.max(F.struct(F.col("pos"), F.col("op.op").alias("flag"), F.col("op.value").alias("val"))).alias("w"))
    return won.select("batch_id", "k", F.col("w.pos").cast("long").alias("pos"), "w.flag", "w.val")


def record_bytes(key: Column, value: Column) -> Column:
    """Bytes of a record in a memtable: key, an eight-byte tag, value."""
    return (F.octet_length(key) + 8 + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def flush_runs(log: DataFrame, buffer_bytes: int) -> DataFrame:
    """The log with the bytes written so far and the run that each record is flushed to."""
    sized = log.withColumn("bytes", record_bytes(F.col("k").cast("string"), F.col("val").cast("string")))
    summed = running_sum(sized, "bytes", "v", name="written")
    return summed.withColumn("run", F.floor((F.col("written") - F.col("bytes")) / buffer_bytes).cast("long"))
