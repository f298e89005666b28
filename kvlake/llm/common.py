"""What the corpus operators share: reading, checkpoints, words, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.folders import shared_folder

#: Text of one slice of an Arrow batch, in bytes; bounds the memory of a task.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the shared checkpoint folder and read it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each has about `size` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // size
        starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(a, b - a)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a filter of 2**bits bits that each (signed) hash has."""
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def bit_filter(hashes: DataFrame, bits: int) -> bytes:
    """The set bits of the hashes (h long) in a filter of 2**bits bits: its size is fixed, however many hashes there are."""
    parts = 64

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        door = np.zeros(1 << bits, bool)
        for batch in batches:
            door[_slots(batch.column("h").to_numpy(), bits)] = True
        for i, part in enumerate(np.split(np.packbits(door), parts)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "bits"])

    def join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, own in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                part = np.frombuffer(own, np.uint8)
                found[i] = found[i] | part if i in found else part
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["part", "bits"])

    rows = hashes.select("h").mapInArrow(set_bits, "part int, bits binary").repartition(parts, "part").mapInArrow(join_bits, "part int, bits binary").collect()  # 64 rows, 2**bits bits
    by_part = {r["part"]: bytes(r["bits"]) for r in rows}
    return b"".join(by_part.get(i, bytes((1 << bits) // 8 // parts)) for i in range(parts))


class Door:
    """A filter as sent to tasks: which hashes it lets through."""

    def __init__(self, bits: bytes):
        self.open = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.bits = int(np.log2(len(self.open)))

    def lets(self, h: np.ndarray) -> np.ndarray:
        return self.open[_slots(h, self.bits)]


def flat_words(texts: list[bytes | None], split) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words end.

    `split` turns the bytes of a text into a list of words.
    """
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += split(t)
        ends[i + 1] = len(words)
    return word_hashes(words), ends


def to_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _not_stars(edges: DataFrame) -> DataFrame:
    """Ids that keep the edges (u, v) from being stars: with two centres, or centre and point at once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("centre")).where("out > 1 or (out = 1 and centre = 0)")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Connected components: (id, component), component the smallest id reachable.

    `links` has two id columns; ids without a link don't appear. Alternates
    large-star and small-star steps (each a grouped minimum and a join) until all
    edges lead from an id to its component, so chains shrink by a factor each round
    and no group is gathered in one task.
    """
    edges = keep(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(rounds):
        if _not_stars(edges).isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = keep(small.where("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def nearby_labels(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id within two links (a, b) of each; ids of one label are connected, not all connected ones share it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("m"))
    two = one.select(F.col("id").alias("m"), F.col("m").alias("component"))
    return keep(one.join(two, "m").select("id", "component"))
