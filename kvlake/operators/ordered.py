"""Ranks, running sums and neighbours over a global order, without one task for all rows.

Rows are sorted by range into partitions; what a partition needs of those before it
(their row counts or totals, one number each) is added as an offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.folders import shared_folder

#: Rows of a key that one task of a join takes; keys with more are dealt over several.
HOT_ROWS = 1_000_000
#: Hot keys are broadcast up to this number; with more, each has a place in the join of its own.
BROADCAST_HOT = 100_000


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _sorted(rows: DataFrame, order: list) -> DataFrame:
    return keep(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def _offsets(rows: DataFrame, value: Column) -> DataFrame:
    """(_part, _before): the sum of the value over earlier partitions, one row a partition."""
    sums = rows.groupBy("_part").agg(F.sum(value).alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before")))


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """`rows` with their place in the order, from 1."""
    at = _sorted(rows, list(order))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.join(_offsets(at, F.lit(1)), "_part").withColumn(name, (inside + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")


def running_sum(rows: DataFrame, value: str, *order, name: str = "running") -> DataFrame:
    """`rows` with the sum of `value` up to and with each row in the order."""
    at = _sorted(rows, list(order))
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return at.join(_offsets(at, F.col(value)), "_part").withColumn(name, (F.sum(value).over(upto) + F.col("_before")).cast("long")).drop("_at", "_part", "_before")


def _beside(at: DataFrame, value: Column, name: str, back: bool) -> DataFrame:
    """Sorted rows with the value (not null) of the row before, or after, each: within partitions, and over their edges by one value a partition."""
    order = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    inside = F.lag(value).over(Window.partitionBy("_part").orderBy(order("_at")))
    edge = at.groupBy("_part").agg((F.max_by if back else F.min_by)(value, "_at").alias("_edge"))
    carried = edge.select("_part", F.lag("_edge").over(Window.orderBy(order("_part"))).alias("_carried"))  # a row a partition
    found = at.withColumn("_inside", inside).join(F.broadcast(carried), "_part")
    return found.withColumn(name, F.coalesce("_inside", "_carried")).drop("_inside", "_carried")


def neighbours(rows: DataFrame, key: str = "k") -> DataFrame:
    """`rows` (unique keys, not null) with the keys before and after each."""
    at = _sorted(rows, [key])
    return _beside(_beside(at, F.col(key), "prev_k", True), F.col(key), "next_k", False).drop("_at", "_part")


def with_previous(rows: DataFrame, columns: list[str], *order, name: str = "before") -> DataFrame:
    """`rows` in an order, each with a struct of the columns of the row before it."""
    at = _sorted(rows, list(order))
    return _beside(at, F.struct(*columns), name, True).drop("_at", "_part")


def join_per_key(rows: DataFrame, per_key: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows` (k, v, ...) with what `per_key` (k, _n, ...) says of their key; _n is the number of the key's rows, by which hot keys are dealt over several tasks."""
    per_key = keep(per_key)
    parts = F.ceil(F.col("_n") / hot_rows).cast("int")
    hot = keep(per_key.where(F.col("_n") > hot_rows).select("k", parts.alias("_parts")))
    if hot.isEmpty():
        return rows.join(per_key.drop("_n"), "k")
    hot = F.broadcast(hot) if hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT else hot
    dealt = rows.join(hot, "k", "left").withColumn("_part", F.pmod(F.xxhash64("v"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1))).drop("_n")
    return dealt.join(spread, ["k", "_part"]).drop("_part")


def first_at_least(probes: DataFrame, keys: DataFrame, probe: str = "probe", key: str = "k") -> DataFrame:
    """For each probe the smallest key that is not smaller, or null: a seek for many targets at once."""
    both = probes.select(F.col(probe).alias("at"), F.lit(0).alias("is_key")).unionByName(keys.select(F.col(key).alias("at"), F.lit(1).alias("is_key")))
    at = _sorted(both, ["at", "is_key"])
    ahead = Window.partitionBy("_part").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("is_key") == 1, F.col("at")), ignorenulls=True).over(ahead)
    firsts = at.groupBy("_part").agg(F.min(F.when(F.col("is_key") == 1, F.col("at"))).alias("first"))
    later = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.broadcast(firsts.select("_part", F.min("first").over(later).alias("beyond")))
    return at.withColumn("inside", inside).join(beyond, "_part").where("is_key = 0").select(F.col("at").alias(probe), F.coalesce("inside", "beyond").alias("found"))
