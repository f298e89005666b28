"""Cursor moves over visible records: seek, next, previous, ranges and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators.ordered import first_at_least, neighbours, ranked


def seek_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy("k").limit(1)


def seek_last(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("k").desc()).limit(1)


def seek(rows: DataFrame, target) -> DataFrame:
    """The first record at or after the target; no row past the end."""
    return rows.where(F.col("k") >= F.lit(target)).orderBy("k").limit(1)


def after(rows: DataFrame, current) -> DataFrame:
    return rows.where(F.col("k") > F.lit(current)).orderBy("k").limit(1)


def before(rows: DataFrame, current) -> DataFrame:
    return rows.where(F.col("k") < F.lit(current)).orderBy(F.col("k").desc()).limit(1)


def walk(rows: DataFrame) -> DataFrame:
    """Every record with the keys that next and previous would go to."""
    return neighbours(rows)


def seek_many(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, found): where a seek to each probe would land."""
    return first_at_least(probes, rows)


def range_scan(rows: DataFrame, low, high) -> DataFrame:
    """Records from low up to, without, high."""
    return rows.where((F.col("k") >= F.lit(low)) & (F.col("k") < F.lit(high)))


def prefix_scan(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col("k").startswith(prefix))


def scan(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """All records with their place in the scan."""
    return ranked(rows, F.col("k").desc() if reverse else F.col("k").asc())


def limit(rows: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    return rows.orderBy(F.col("k").desc() if reverse else F.col("k").asc()).limit(n)
