"""Recovery from a log: reassembly of fragments, the prefix before the first bad record, and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators.ordered import ranked, running_sum


def fragments(records: DataFrame, block: int, header: int = 7) -> DataFrame:
    """(rec, payload) cut into fragments of at most block - header characters: (pos order) rec, part, type, payload."""
    room = block - header
    parts = F.greatest(F.lit(1), F.ceil(F.length("payload") / room)).cast("int")
    cut = records.withColumn("parts", parts).select("rec", "payload", "parts", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    kind = F.when(F.col("parts") == 1, "FULL").when(F.col("part") == 1, "FIRST").when(F.col("part") == F.col("parts"), "LAST").otherwise("MIDDLE")
    return cut.select("rec", "part", kind.alias("type"), F.substring("payload", (F.col("part") - 1) * room + 1, F.lit(room)).alias("payload"))


def reassemble(log: DataFrame) -> DataFrame:
    """(pos, type, payload) to whole records: rec counts them from 1, payload is put together in order."""
    starts = log.withColumn("start", F.col("type").isin("FULL", "FIRST").cast("long"))
    numbered = running_sum(starts, "start", "pos", name="rec")
    parts = numbered.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("p"))
    return parts.select("rec", F.array_join(F.transform("p", lambda x: x["payload"]), "").alias("payload"))


def valid_prefix(log: DataFrame, bad) -> DataFrame:
    """Records before the first bad one."""
    first = log.where(bad).agg(F.min("pos").alias("first_bad"))
    return log.crossJoin(F.broadcast(first)).where(F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))).drop("first_bad")  # one row


def checksum(payload: str = "payload"):
    return F.crc32(F.col(payload).cast("binary"))


def replay(log: DataFrame, last_version: int) -> DataFrame:
    """The records (pos, payload, crc, ...) before the first one whose checksum fails, with the versions last_version + 1, ... that a replay gives them."""
    good = valid_prefix(log, ~checksum().eqNullSafe(F.col("crc")))
    return ranked(good, "pos", name="_n").withColumn("v", F.col("_n") + last_version).drop("_n")
