"""Operator 2: benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some token positions. A hash of the tokens that a mask keeps,
at each position of each benchmark item and of each document, is compared; a
common hash puts the item on a diagonal of the document. Around such hits the two
texts are compared token by token along the diagonal, so substitutions are
tolerated, and the longest stretch with enough equal tokens is the overlap.
An overlap begins and ends with an equal token, so an item of SHORT tokens or fewer,
too short for the masks, has one seed more: its first and last token.

Tokens are runs of ASCII letters, digits and non-ASCII bytes after lower-casing
A-Z; everything else separates. They are compared by 64-bit hashes.

Hits only tell which documents meet which items; their diagonals are found again where
the two texts are, so no list of places is gathered. All diagonals of a pair are
compared, in blocks, and those that can't be the longest overlap are passed over.

Defined cases: null and empty texts hit nothing; very long texts are compared whole; an item shorter than
`min_words` must be found over its whole length, and an item without tokens is
never found; of overlaps that tie in length the one with more equal tokens, then the first in the
document, then in the item counts; null doc_id or item_id are kept as null; rows with equal ids are
reported once for each id pair, by their longest overlap; empty tables give no
rows. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import Door, bit_filter, flat_words, keep, mix, slices, table, to_signed, word_hashes

#: Fixed spaced seeds: 1 keeps a token, 0 ignores it. Weight 6 or 7, spans 8 to 13.
MASKS = ("11101011", "1101100101", "10110010011", "1100101000111")
#: An overlap has so many tokens at least, of which so many in ten are equal.
MIN_WORDS, TENTHS = 13, 8
#: Items of up to so many tokens are sought by their first and last token as well.
SHORT = 13
#: Benchmark hashes are broadcast up to this number (16 bytes each); beyond it, hits come from a shuffled join,
#: for which a filter of 2**FILTER_BITS bits lets through what the benchmark has.
BROADCAST_HASHES, FILTER_BITS = 1_000_000, 26
#: Pairs of tokens that are compared at once.
BLOCK = 1 << 20
#: Ids of hit documents are broadcast up to this number.
BROADCAST_IDS = 100_000

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def seeds(words: np.ndarray, ends: np.ndarray, lengths: Sequence[int] = (), whole_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask, and the first and last of each of `lengths` tokens: hashes, text number and token position of all places in the texts.

    With whole_only, the seeds of `lengths` are those of whole texts.
    """
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    place = np.arange(len(words)) - ends[owner]
    left = ends[owner + 1] - np.arange(len(words))
    for m, mask in enumerate(MASKS):
        whole = np.flatnonzero(left >= len(mask))
        h = np.full(len(whole), (m + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[whole + k])
        yield h, owner[whole], place[whole]
    for n in lengths:
        whole = np.flatnonzero((left == n) & (place == 0) if whole_only else left >= n)
        h = mix(words[whole] + np.uint64((len(MASKS) + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[whole + n - 1])
        yield h, owner[whole], place[whole]


def _bytes(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _seed_rows(lengths: Sequence[int], whole_only: bool = False, door=None):
    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (h, id): the different seeds of every text, those that a filter lets through."""
        gate = door and Door(door.value)
        for batch in slices(batches):
            words, ends = flat_words(_bytes(batch.column(1)), tokens)
            for h, owner, _ in seeds(words, ends, lengths, whole_only):
                h = to_signed(h)
                if gate:
                    let = gate.lets(h)
                    h, owner = h[let], owner[let]
                h, owner = _different(h, owner)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(owner))], ["h", "id"])

    return seed_rows


def _different(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of hash and text once."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _short_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item) to the numbers of tokens of short items."""
    found: set[int] = set()
    for batch in batches:
        found.update(n for t in _bytes(batch.column(0)) if 0 < (n := len(tokens(t))) <= SHORT)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["n"])


def _hits_by_broadcast(shared, lengths: Sequence[int]):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (id, item_no): which texts have a seed of which items."""
        known, item = shared.value
        door = np.zeros(1 << 22, bool)
        door[known >> np.uint64(42)] = True
        for batch in slices(batches):
            words, ends = flat_words(_bytes(batch.column(1)), tokens)
            for h, owner, _ in seeds(words, ends, lengths):
                near = np.flatnonzero(door[h >> np.uint64(42)])
                near_h, own = _different(h[near], owner[near])
                low, high = np.searchsorted(known, near_h, "left"), np.searchsorted(known, near_h, "right")
                count = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                if len(at):
                    no, own = _different(item[at], np.repeat(own, count))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(no)], ["id", "item_no"])

    return hits


def longest(equal: np.ndarray, tenths: int = TENTHS) -> tuple[int, int]:
    """The longest stretch that begins and ends with an equal token, with tenths/10 equal at least; of several the first."""
    ends = np.flatnonzero(equal) + 1
    if not len(ends):
        return 0, 0
    score = np.concatenate([[0], np.cumsum(np.where(equal, 10 - tenths, -tenths))])
    lowest = np.minimum.accumulate(score)
    starts = np.searchsorted(-lowest, -score[ends])  # the first places with a score of at most that of the end
    starts = (ends - 1)[np.searchsorted(ends - 1, starts)]  # the next equal token
    length = np.where(score[ends] >= score[starts], ends - starts, 0)
    best = int(length.argmax())
    return (int(starts[best]), int(ends[best])) if length[best] > 0 else (0, 0)


def _shifts(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """The diagonals (place in the text less place in the item) on which the two share a seed, in order."""
    marks = np.zeros(len(mine) + len(theirs), bool)
    length = [len(theirs)] if len(theirs) <= SHORT else []
    both = (seeds(words, np.array([0, len(words)]), length) for words in (mine, theirs))
    for (h, _, place), (g, _, at) in zip(*both, strict=True):
        near = np.flatnonzero(np.isin(h, g))
        near = near[np.argsort(h[near], kind="stable")]
        low, high = np.searchsorted(h[near], g, "left"), np.searchsorted(h[near], g, "right")
        for k in np.flatnonzero(high > low):
            marks[place[near[low[k] : high[k]]] - at[k] + len(theirs)] = True
    return np.flatnonzero(marks) - len(theirs)


def overlap(mine: np.ndarray, theirs: np.ndarray, min_words: int, tenths: int) -> tuple[int, int, int, int] | None:
    """The longest overlap of a text and an item (hashes of tokens): length, equal tokens, place in the text, place in the item; None if it is too short."""
    need = min(min_words, len(theirs))
    best = None
    shifts = _shifts(mine, theirs)
    size = max(1, BLOCK // max(1, len(theirs)))
    place = np.arange(len(theirs))
    for block in np.split(shifts, range(size, len(shifts), size)):
        at = block[:, None] + place
        inside = (at >= 0) & (at < len(mine))
        equal = inside & (mine[np.where(inside, at, 0)] == theirs)
        count = equal.sum(axis=1)
        most = np.minimum(count * 10 // tenths, inside.sum(axis=1))
        for k in np.flatnonzero(most >= need):
            first = max(0, int(block[k]))  # no overlap on this diagonal begins before
            if best and (most[k], count[k], -first) < (best[0], best[1], -best[2]):
                continue
            start, end = longest(equal[k], tenths)
            if end - start >= need > 0:
                found = (end - start, int(equal[k, start:end].sum()), start + int(block[k]), start)
                if best is None or (*found[:2], -found[2], -found[3]) > (*best[:2], -best[2], -best[3]):
                    best = found
    return best


def _verify(min_words: int, tenths: int):
    def hashed(text: bytes) -> np.ndarray:
        return word_hashes(tokens(text))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, item_id, text, item) to the longest overlap of each pair that has one long enough."""
        last, mine = None, None
        for batch in slices(batches):
            rows = []
            for doc_id, item_id, text, item in zip(*(_bytes(c) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns), strict=True):
                if text != last:  # rows of one text mostly follow each other
                    last, mine = text, hashed(text)
                theirs = hashed(item)
                if found := overlap(mine, theirs, min_words, tenths):
                    rows.append((doc_id, item_id, *found, len(theirs)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [batch.column(0).type, batch.column(1).type, *[pa.int64()] * 5], strict=True)], ["doc_id", "item_id", "n_words", "n_equal", "doc_word", "item_word", "item_words"])

    return verify


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, tenths: int = TENTHS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row for each document and item that overlap: the longest overlap and where it stands.

    doc_id, item_id, n_words (length), n_equal (equal tokens), doc_word and
    item_word (where it starts, in tokens), item_words (tokens of the item).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    items = benchmark.select(F.col("item_id"), F.col("text").alias("item")).where("item is not null").distinct()
    items = items.withColumn("item_no", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "item"))
    items = keep(items)
    id_type = texts.schema["id"].dataType.simpleString()
    lengths = sorted(r["n"] for r in items.select("item").mapInArrow(_short_lengths, "n int").distinct().collect())  # SHORT rows at most
    known = keep(items.select(F.col("item_no").alias("id"), F.col("item").alias("text")).mapInArrow(_seed_rows(range(1, SHORT + 1), whole_only=True), "h long, id long").distinct())
    if known.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        rows = known.toPandas()
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h, kind="stable")
        shared = spark.sparkContext.broadcast((h[order], rows["id"].to_numpy(np.int64)[order]))
        hits = texts.mapInArrow(_hits_by_broadcast(shared, lengths), f"id {id_type}, item_no long")
    else:
        door = spark.sparkContext.broadcast(bit_filter(known, FILTER_BITS))
        mine = texts.mapInArrow(_seed_rows(lengths, door=door), f"h long, id {id_type}")
        hits = mine.join(known.select("h", F.col("id").alias("item_no")), "h").select("id", "item_no")
    pairs = keep(hits.distinct())
    ids = pairs.select("id").distinct()
    if pairs.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    hit_texts = texts.withColumnRenamed("id", "tid").join(ids, F.col("tid").eqNullSafe(F.col("id")), "left_semi")
    verified = (
        pairs.join(items, "item_no")
        .join(hit_texts, F.col("id").eqNullSafe(F.col("tid")))
        .select(F.col("id").alias("doc_id"), "item_id", "text", "item")
        .mapInArrow(_verify(min_words, tenths), f"doc_id {id_type}, item_id {items.schema['item_id'].dataType.simpleString()}, n_words long, n_equal long, doc_word long, item_word long, item_words long")
    )
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"), "item_words"))
    return (
        verified.groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.n_words", "b.n_equal", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"), "b.item_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that overlap a benchmark item."""
    leaked = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; rows are the leaks found."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
