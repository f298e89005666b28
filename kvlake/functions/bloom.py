"""Bloom filters as relations of bit positions, with five string hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.hashes import HASHES

#: The bits of a filter are broadcast up to this number.
BROADCAST_BITS = 1 << 20


def _positions(bits: int):
    return F.array(*[f(F.col("s")) % bits for f in HASHES.values()])


def build(rows: DataFrame, bits: int) -> DataFrame:
    """The set bits (bit) of a filter that the strings `s` were offered to."""
    return rows.select(F.explode(_positions(bits)).alias("bit")).distinct()


def test(rows: DataFrame, filter_bits: DataFrame, bits: int) -> DataFrame:
    """Each distinct string `s` with whether the filter may hold it: all five bits are set."""
    known = F.broadcast(filter_bits) if bits <= BROADCAST_BITS else filter_bits
    asked = rows.select("s").distinct().select("s", F.explode(F.array_distinct(_positions(bits))).alias("bit"))
    hit = asked.join(known.withColumn("hit", F.lit(1)), "bit", "left")
    return hit.groupBy("s").agg((F.count("hit") == F.count("*")).alias("present"))


def count(filter_bits: DataFrame) -> DataFrame:
    """About how many strings were offered: set bits by hashes."""
    return filter_bits.agg(F.floor(F.count("*") / len(HASHES)).cast("long").alias("n"))


def used_share(bits: DataFrame, size: int) -> DataFrame:
    """The share of set bits of a bitmap of `size`."""
    return bits.distinct().agg(F.round(F.count("*") / F.lit(float(size)), 6).alias("ratio"))
