"""Merging sorted runs: the union of all in the order of keys, newest first, equal records by run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.operators.ordered import ranked
from kvlake.operators.visible import visible


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All runs' rows with the number of their run; nothing is dropped."""
    return reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)])


def merged_visible(spark: SparkSession, runs: list[DataFrame], snapshot: int | None = None) -> DataFrame:
    """What an iterator over several runs shows at a snapshot: the visible records (k, v, val) in the order of keys, with rank."""
    if not runs:
        return spark.createDataFrame([], "k string, v long, val double, rank long")
    return ranked(visible(union_runs(runs), snapshot), "k")


def merge(spark: SparkSession, runs: list[DataFrame], schema: str = "k string, v long, flag int, val double", reverse: bool = False) -> DataFrame:
    """The merged rows with run and rank; equal (k, v) come by run. reverse is the exact reverse."""
    if not runs:
        return spark.createDataFrame([], f"{schema}, run int, rank long")
    order = [F.col("k").asc(), F.col("v").desc(), F.col("run").asc()]
    if reverse:
        order = [F.col("k").desc(), F.col("v").asc(), F.col("run").desc()]
    return ranked(union_runs(runs), *order)
