"""Labelled rows for classifiers: the hold-out rule and a bounded sample to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents never trained on: crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, each: bool = False) -> DataFrame:
    """Up to `rows` labelled texts to train on, as (order, text, label); none held out.

    The rows with the smallest hashes of their ids are taken (with `each`, half of
    them of either label), so the sample does not depend on partitions. Ids with
    contradicting labels, and null ids, texts and labels, are left out.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where(F.col("label_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("label_id"))
    order = F.xxhash64(F.lit("train"), F.col("label_id").cast("string"))
    parts = [known.where(F.col("label") == k).orderBy(order).limit(rows // 2) for k in (0, 1)] if each else [known.orderBy(order).limit(rows)]
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    chosen = chosen.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = found.select(F.xxhash64(F.lit("train"), F.col("label_id").cast("string"), "text").alias("order"), "text", "label")
    return found.orderBy("order", "text").limit(rows)
