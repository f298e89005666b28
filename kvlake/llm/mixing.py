"""Operator 10: mixing sources to target weights by Poisson replication.

Each source gets the mean number of copies a document of it must have for the
mix to reach its target share. The number of copies of one document is drawn
from a Poisson distribution with that mean, by inverting its distribution
function at a uniform number hashed from the seed and the document, so that it
is the same in each run and in each retried task. Documents are exploded by
their count and dealt out in the order of a hash: a global shuffle.

Large means are drawn as a sum of independent pieces of mean PIECE at most,
each with a hash of its own, so no mean is too large for exact arithmetic. A
document of more than PIECES pieces (a source that is much too small for its target) is
dealt out by groups of pieces first, so that no task holds all its copies.

The shuffle deals rows to partitions by a hash and orders each partition by it: which
rows come together, and in which order, is left to the hash alone.

Defined cases: a null source is a source of its own; a null doc_id hashes as a value
of its own, unlike any text; rows with equal doc_id and source draw the same count,
ties in mix_key (repeated rows) stay next to each other; null, empty and very long texts are mixed as any
other; sources with no target weight get weight 0 (no copy) when `weights` is given, and sources with a
weight but no documents are left out of the total; an empty table gives no rows. Columns
of the input that clash with added ones (copy, mix_key) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import keep, table

#: Largest mean that one hash draws.
PIECE = 8.0
#: Terms of the distribution function at mean PIECE; what is left is below 2**-52.
TERMS = 48
#: Most pieces of a document that one row is exploded to at once.
PIECES = 64
#: Rates are broadcast up to so many sources; beyond that the join shuffles.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def _unit(*parts) -> F.Column:
    """A uniform number in [0, 1) from a hash of the parts, in steps of 2**-48."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _poisson_table(mean) -> F.Column:
    """The distribution function at 0, 1, ... TERMS-1 as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step)["cdf"]


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """One row per source: n documents, target rows and the mean number of copies.

    `weights` names target weights (all sources alike when None); `total` is the
    number of rows the mix shall have (as many as there are documents when None).
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in weights if k is not None]).cast("array<string>"), F.array(*[F.lit(float(v)) for k, v in weights.items() if k is not None]).cast("array<double>"))
        none = float(weights.get(None, 0.0))
        weighted = counts.withColumn("weight", F.when(F.col("source").isNull(), none).otherwise(F.coalesce(F.try_element_at(pairs, F.col("source").cast("string")), F.lit(0.0))))
    sums = weighted.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows"))
    wanted = F.lit(float(total)) if total is not None else F.col("rows").cast("double")
    return weighted.crossJoin(F.broadcast(sums)).select(
        F.col("source").alias("rate_source"),
        "n",
        "weight",
        F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * wanted / F.col("n")).otherwise(0.0).alias("rate"),
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """`docs` replicated to the target weights and globally shuffled, with copy and mix_key.

    copy tells the replicas of a document apart: those of its first piece are 0, 1, ..., those
    of the next one TERMS, TERMS + 1, ...; mix_key is the hash by which
    the rows are dealt out and sorted within partitions.
    """
    rates = source_rates(docs, weights, total)
    rates = rates.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("long"))
    rates = keep(rates.withColumn("cdf", _poisson_table(F.col("rate") / F.col("pieces"))).select("rate_source", "pieces", "cdf"))
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    key = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("null"))
    rows = docs.select(F.struct(*kept).alias("row"), F.col("source").alias("row_source"), key.alias("key"))

    def with_rates(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if few else some, F.col("row_source").eqNullSafe(F.col("rate_source"))).select("row", "key", "pieces", "cdf")

    few_pieces = F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces")))
    parts = with_rates(rates.where(F.col("pieces") <= PIECES)).select("row", "key", "cdf", few_pieces.alias("piece"))
    many = rates.where(F.col("pieces") > PIECES)
    if not many.isEmpty():
        # First by groups of groups of pieces, then by groups, dealt out anew each time: no row explodes to more than a share of its copies.
        size = PIECES * PIECES
        firsts = F.sequence(F.lit(1).cast("long"), F.col("pieces"), F.lit(size).cast("long"))
        dealt = with_rates(many).withColumn("first", F.explode(firsts)).repartition("key", "first")
        firsts = F.sequence(F.col("first"), F.least(F.col("pieces"), F.col("first") + size - 1), F.lit(PIECES).cast("long"))
        dealt = dealt.withColumn("first", F.explode(firsts)).repartition("key", "first")
        last = F.least(F.col("pieces"), F.col("first") + PIECES - 1)
        parts = parts.unionByName(dealt.select("row", "key", "cdf", F.explode(F.sequence(F.col("first"), last)).alias("piece")))
    unit = _unit(F.lit(seed), F.col("key"), F.col("piece").cast("string"))
    counted = parts.withColumn("u", unit).withColumn("copies", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    copied = counted.where("copies > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copied = copied.withColumn("copy", ((F.col("piece") - 1) * TERMS + F.col("n")).cast("long"))
    mix_key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "key", F.col("copy").cast("string")))
    return copied.select("row.*", "copy", mix_key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal shares, as many rows as there are documents; whole texts."""
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT count(*) AS k, sum(n) AS docs FROM s),
r AS (SELECT source, 1.0::DOUBLE / k * docs::DOUBLE / n AS rate FROM s, t),
p AS (SELECT source, greatest(1, ceil(rate / {PIECE}))::INT AS pieces, rate / greatest(1, ceil(rate / {PIECE})) AS mean FROM r),
f AS (
  SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS c, mean FROM p
  UNION ALL SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean FROM f WHERE k < {TERMS - 1}),
g AS (SELECT source, list(c ORDER BY k) AS cdf FROM f GROUP BY source),
d AS (
  SELECT d.*, coalesce('id ' || d.doc_id::VARCHAR, 'null') AS key, unnest(range(1, p.pieces + 1)) AS piece, g.cdf
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT *, len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}:' || key || ':' || piece), 1, 12))::BIGINT / {float(1 << 48)!r}))::BIGINT AS copies FROM d),
e AS (SELECT *, (piece - 1) * {TERMS} + unnest(range(0, copies)) AS copy FROM c WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy, md5('{SEED}:order:' || key || ':' || copy) AS mix_key FROM e
"""


def left_over(mean: float = PIECE, terms: int = TERMS) -> float:
    """The share of the distribution beyond the table, to show that it is nothing."""
    p, c = math.exp(-mean), math.exp(-mean)
    for k in range(1, terms):
        p *= mean / k
        c += p
    return max(0.0, 1.0 - c)
