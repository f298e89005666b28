"""What a reader sees of an operation log: the newest record of a key at a snapshot, deletions hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.ordered import with_previous
from kvlake.sources.tables import DELETION, VALUE

#: Keys of a multi-get are broadcast up to this number; beyond it the join shuffles.
BROADCAST_KEYS = 100_000
#: Runs that one read may merge; with versions up to 2**50 the order key of version and run fits in 64 bits (beyond that Spark reports an overflow).
MOST_RUNS = 1 << 12


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest record of each key with a version of at most the snapshot, deletions too.

    One grouped aggregation with partial results before the shuffle, hashed as all its buffers
    are plain numbers (a struct would have the log sorted); all columns are taken by one order key,
    so of one record. Of records with equal key and version the one of the first run is taken
    (by `run`, where the log has it), as in a merge; without runs any one of them.
    """
    rows = log if snapshot is None else log.where(F.col("v") <= snapshot)
    order = F.col("v") * MOST_RUNS + (MOST_RUNS - 1 - F.col("run")) if "run" in log.columns else F.col("v")
    columns = [F.max_by(c, order).alias(c) for c in ("flag", "val")]
    return rows.groupBy("k").agg(F.max("v").alias("newest"), *columns).select("k", F.col("newest").alias("v"), "flag", "val")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(k, v, val) of live keys. The snapshot applies before, deletions after the newest is chosen."""
    return newest(log, snapshot).where(F.col("flag") == VALUE).select("k", "v", "val")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The visible record of one key; no row if it is absent or deleted."""
    return visible(log.where(F.col("k") == key), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The visible records of the keys in `keys` (one column k)."""
    wanted = keys.select("k").distinct()
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    return visible(log.join(wanted, "k", "left_semi"), snapshot)


def history(log: DataFrame, key) -> DataFrame:
    """All versions of a key, with their place from the newest on."""
    return log.where(F.col("k") == key).withColumn("age", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc())).cast("long"))


def tombstones(log: DataFrame) -> DataFrame:
    return log.where(F.col("flag") == DELETION)


def previous_values(log: DataFrame) -> DataFrame:
    """Each record with the value that it replaced (by range partitions, so no key's versions are gathered)."""
    rows = with_previous(log, ["k", "val"], "k", "v", name="_before")
    return rows.withColumn("previous", F.when(F.col("_before.k").eqNullSafe(F.col("k")), F.col("_before.val"))).drop("_before")


def upserts(log: DataFrame, writes: DataFrame) -> DataFrame:
    """Each write (k, v, flag, val) with whether its key and version are in the log already, and the value that stands there."""
    there = log.select("k", "v", F.lit(True).alias("_there"), F.col("val").alias("old_value"))
    found = writes.join(there, ["k", "v"], "left")
    return found.select(*writes.columns, F.coalesce("_there", F.lit(False)).alias("already_existed"), "old_value")


def newest_version(log: DataFrame) -> int:
    """The version that a snapshot taken now would read at (-1 for an empty log)."""
    top = log.agg(F.max("v")).first()[0]
    return -1 if top is None else top
