"""Operator 6: quality classifier, logistic regression on hashed word n-grams.

Features are word n-grams (one and two words) of two readings of a text: the
words as they are, and their shapes (runs of letters, capitals, digits and marks;
a word that repeats the one before it has a shape of its own). Each is hashed to
one of 2**BITS weights; its value is its share of the text times SCALE. Weights
are learnt by follow-the-regularised-leader updates (FTRL-proximal) over a
bounded sample of labelled rows; a score is a sparse dot product of a text.

Defined cases: null and empty texts have no features and get the score of the
bias alone; very long texts and words are read whole; with no labelled rows all scores are
0.5; a null doc_id is never held out; n-grams whose hashes tie share a weight, examples
that tie in their order are trained in the order of their texts; repeated rows give repeated results; other
columns pass by unread, and a column of theirs named as the score is replaced by `score` but kept by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import fresh, mix, slices, table, word_hashes
from kvlake.llm.labelled import held_out, sample

BITS = 20
SCALE = 8.0
#: Bound of the sample to train on, in rows.
TRAIN_ROWS = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.3, 1.0, 0.05, 0.5
#: A document is kept from this score on.
THRESHOLD = 0.3

_SHAPES = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1"))


def shape(word: bytes) -> bytes:
    text = word.decode("utf-8", "replace")
    for pattern, mark in _SHAPES:
        text = pattern.sub(mark, text)
    return text.encode()


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the n-grams of all texts in a row, and where each text's end."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = t.encode("utf-8", "replace").split() if t else []
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h = word_hashes(words)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    shapes = word_hashes([b"shape " + shape(words[i]) for i in first])[inverse]
    starts = np.zeros(len(words), bool)
    starts[(np.cumsum(counts) - counts)[counts > 0]] = True
    again = np.concatenate([[False], h[1:] == h[:-1]]) & ~starts
    shapes[again] = np.uint64(0x5EED)
    grams = [h, shapes]
    for unigrams in (h, shapes):
        before = np.concatenate([[np.uint64(1)], unigrams[:-1]])
        before[starts] = np.uint64(1)
        grams.append(mix(before * np.uint64(31) + unigrams))
    index = (mix(np.stack(grams, axis=1)) >> np.uint64(64 - bits)).astype(np.int64).ravel()
    return index, np.concatenate([[0], np.cumsum(counts * len(grams))])


def _train(bits: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(order, text, label) to the weights that are not zero; the bias is at 2**bits."""
        examples = []
        for batch in slices(batches):
            index, ends = features(batch.column("text").to_pylist(), bits)
            for i, label in enumerate(batch.column("label").to_pylist()):
                own, n = np.unique(index[ends[i] : ends[i + 1]], return_counts=True)
                examples.append((batch.column("order")[i].as_py(), np.append(own, 1 << bits).astype(np.int32), np.append(SCALE * n / max(1, n.sum()) * 4, 1.0).astype(np.float32), label))
        examples.sort(key=lambda e: (e[0], e[3]))
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for _ in range(EPOCHS):
            for _, own, x, label in examples:
                zs, ns = z[own], n[own]
                w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
                p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - label) * x
                z[own] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
                n[own] += g * g
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    return train


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """The weights, learnt in one task over a sample of at most `rows` texts."""
    learnt = sample(docs, labels, label, rows).repartition(1).mapInArrow(_train(bits), "at long, w double")
    weights = np.zeros((1 << bits) + 1)
    for r in learnt.collect():  # at most 2**bits + 1 rows
        weights[r["at"]] = r["w"]
    return weights


def _score(shared, bits: int, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches):
            index, ends = features(batch.column("text").to_pylist(), bits)
            sums = np.concatenate([[0.0], np.cumsum(w[index])])
            size = np.maximum(1, np.diff(ends))
            margin = w[-1] + 4 * SCALE * (sums[ends[1:]] - sums[ends[:-1]]) / size
            scored = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scored)], [*batch.schema.names, name])

    return score


def score(docs: DataFrame, weights: np.ndarray, name: str = "_score") -> DataFrame:
    """`docs` with the score of each text as `name`."""
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(shared, bits, name), f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """`docs` without those that the classifier rejects."""
    name = fresh("_score", docs.columns)
    return score(docs, train(docs, labels, **options), name).where(F.col(name) >= threshold).drop(name)


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, whole texts."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
