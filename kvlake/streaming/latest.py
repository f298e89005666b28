"""The newest record of each key over a stream of an operation log: an addition to the batch operators.

The stream is aggregated by key with the newest version winning, so late records of
an older version change nothing; a deletion stays as the newest record until readers
filter it. Micro-batches are upserted into a Parquet folder of versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.folders import shared_folder
from kvlake.operators.visible import newest
from kvlake.sources.tables import DELETION, VALUE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (k, v, flag, val)."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.when(F.col("event_type") == "error", DELETION).otherwise(VALUE).alias("flag"), F.col("value").alias("val"))


def append_newest(out: str):
    """A micro-batch writer: the newest record of each key of the batch, as a sorted run of its own (a retried batch overwrites its run)."""

    def write(batch: DataFrame, number: int) -> None:
        newest(batch).repartitionByRange("k").sortWithinPartitions("k", F.col("v").desc()).write.mode("overwrite").parquet(f"{out}/run={number}")

    return write


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the stream at once; the newest record of each key over its runs."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = event_stream(spark, sf_dir).writeStream.foreachBatch(append_newest(f"{folder}/runs")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return newest(spark.read.parquet(f"{folder}/runs"))
