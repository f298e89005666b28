"""Operator 5: n-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct K-word shingles, as 64-bit hashes. Documents with
equal sets form a class with one representative. All shingles of the corpus are
counted into a sketch, whose counters grow with the documents up to 2**MOST_BITS; shingles
that are frequent within slices of text are counted by themselves as well, the HEAVY most
frequent of them. The shingles of a representative are put in the order of those counts, rare first (any order that
is the same for all documents is right; a rare-first one makes few candidates). Two
sets that are similar enough share a shingle of their prefixes.

Candidates are pairs that meet in the group of a prefix shingle and pass the length
filter, the positional filter (what can still be common after that place) and the
suffix filter (what can be common at most by counts of the sets in SPANS ranges of
hashes). They are verified once, on whole texts.

Copies by the thousand would meet in quadratically many pairs. So the join runs in
rounds. First each member of a group meets one hub of it, and what is found similar
is one component; then groups that lie in one component are done, and the members of
the others meet other hubs; last, each member of a group outside of the group's
largest component meets all members of other components. Pairs inside of a component
need no check as they can't change it, and no other pair is left out, so components
are exact.

Copies of a class take no part in this: at the end each document gets the component of its
class, by a join that deals large classes out over SALTS keys.

Defined cases: very long texts are read whole; shingles that tie in frequency are ordered by their hashes; without words or text a set is empty and linked with nothing; a null
doc_id has a null component; rows with equal doc_id are one node, linked if any of
their texts are; repeated rows give repeated results; an empty table gives no rows;
other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import components, flat_words, keep, mix, nearby_labels, slices, table, to_signed

#: Shingles of K words; sets link from NUM / DEN on.
K, NUM, DEN = 4, 85, 100
#: Counters of the sketch that orders shingles: 2**ORDER_BITS, twice as many for each doubling of the documents beyond 2**20, in BLOCKS blocks.
ORDER_BITS, MOST_BITS, BLOCKS = 18, 22, 64
#: A shingle of so many documents of a slice is counted by itself; so many of the most frequent ones are kept (16 bytes each).
FREQUENT, HEAVY = 16, 100_000
#: Keys over which the members of a class are dealt.
SALTS = 16
#: Hash ranges of the suffix filter.
SPANS = 48
#: Rounds in which members meet one hub each, before the rest meets in full.
HUB_ROUNDS = 1
#: Ids are broadcast up to this number; beyond it, texts are joined by a shuffle.
BROADCAST_IDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def shingle_sets(texts: list[bytes | None], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts in a row, each sorted by hash, and where each ends."""
    words, ends = flat_words(texts, split)
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(texts)), counts)
    left = ends[owner + 1] - np.arange(len(words))
    whole = left >= k
    starts = np.flatnonzero(whole)
    h = np.full(len(starts), k, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[starts + j])
    short = np.flatnonzero((counts > 0) & (counts < k))
    few = np.zeros(len(short), np.uint64)
    for i, text in enumerate(short):
        one = np.full(1, counts[text], np.uint64)
        for w in words[ends[text] : ends[text + 1]]:
            one = mix(one * np.uint64(0x9E3779B97F4A7C15) + w)
        few[i] = one[0]
    own, h = np.concatenate([owner[starts], short]), np.concatenate([h, few])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    own, h = own[new], h[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]).astype(np.int64)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])[ends])


def _facts(k: int, bits: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to a row for each document: its set's size and digest; rows for frequent shingles (doc_id and block null); last, the task's part of the sketch."""
        counts = np.zeros(1 << bits, np.int64)
        names = ["doc_id", "n", "c1", "c2", "block", "counts"]
        kind = None
        for batch in slices(batches):
            kind = batch.column("doc_id").type
            h, ends = shingle_sets(_texts(batch), k)
            counts += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(to_signed(_sums(mix(h), ends))), pa.array(to_signed(_sums(mix(h ^ np.uint64(0xA5A5A5A5)), ends))), none, pa.nulls(batch.num_rows, pa.binary())], names
            )
            ordered = np.sort(h)
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([starts, [len(ordered)]]))
            often = times >= FREQUENT
            if m := int(often.sum()):
                nulls = [pa.nulls(m, kind), pa.array(times[often]), pa.array(to_signed(ordered[starts[often]])), pa.nulls(m, pa.int64()), pa.array([-1] * m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(nulls, names)
        if kind is not None:
            parts = [p.astype(np.int64).tobytes() for p in np.split(counts, BLOCKS)]
            nulls = [pa.nulls(BLOCKS, t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return facts


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of the sketch, block by block, as they stream in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(part, np.int64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])


def _prefixes(shared, k: int, num: int, den: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to the document's prefix, rare shingles first, its digest and its counts by hash range."""
        often, heavy, times = shared.value
        shift = np.uint64(64 - int(np.log2(len(often))))
        for batch in slices(batches):
            h, ends = shingle_sets(_texts(batch), k)
            sizes = np.diff(ends)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            count = often[(h >> shift).astype(np.int64)]
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                count = count + np.where(heavy[at] == h, times[at], 0)
            order = np.lexsort((h, count, owner))
            length = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
            inside = np.arange(len(h)) - ends[owner] < length[owner]
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(to_signed(h[order][inside])))
            spans = np.bincount(owner * SPANS + ((h & np.uint64(0xFFFF)) * np.uint64(SPANS) >> np.uint64(16)).astype(np.int64), minlength=len(sizes) * SPANS).astype(np.int32)
            rows = [spans[i * SPANS : (i + 1) * SPANS].tobytes() for i in range(len(sizes))]
            digests = [pa.array(to_signed(_sums(mix(h), ends))), pa.array(to_signed(_sums(mix(h ^ np.uint64(0xA5A5A5A5)), ends)))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *digests, tokens, pa.array(rows, pa.binary())], ["doc_id", "n", "c1", "c2", "tokens", "spans"])
            yield out.filter(pa.array(sizes > 0))

    return prefixes


def _suffix_filter(num: int, den: int):
    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose counts by hash range leave enough in common."""
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(batch.num_rows, SPANS) for c in ("spans_a", "spans_b"))
            common = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            union = a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - common
            yield batch.select(["a", "b"]).filter(pa.array(den * common >= num * union))

    return suffix_filter


def _sets_once(batch: pa.RecordBatch, name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts in a row, each different text read once: pairs of a hub follow each other."""
    coded = batch.column(name).cast(pa.binary()).dictionary_encode()
    h, ends = shingle_sets(coded.dictionary.to_pylist(), k)
    which = coded.indices.to_numpy()
    sizes = np.diff(ends)[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(ends[which] - out[:-1], sizes) + np.arange(out[-1])
    return h[at], out


def _verify(k: int, num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, text_a, text_b) to the pairs that link, with the sizes of intersection and union."""
        for batch in slices(batches, "text_a"):
            for part in slices(iter([batch]), "text_b"):
                (ha, ea), (hb, eb) = _sets_once(part, "text_a", k), _sets_once(part, "text_b", k)
                na, nb = np.diff(ea), np.diff(eb)
                own = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                h = np.concatenate([ha, hb])
                order = np.lexsort((h, own))
                own, h = own[order], h[order]
                common = np.bincount(own[1:][(own[1:] == own[:-1]) & (h[1:] == h[:-1])], minlength=len(na))
                union = na + nb - common
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common), pa.array(union)], ["a", "b", "n_common", "n_union"])
                yield out.filter(pa.array((den * common >= num * union) & (common > 0)))

    return verify


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents whose ids are in `ids`; ids are broadcast only while they are few."""
    ids = keep(ids.distinct())
    wanted = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id", "left_semi")


def similar_pairs(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts' sets link."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, num, den), f"a {kind}, b {kind}, n_common long, n_union long")


def join_classes(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, order_bits: int | None = None, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    Two documents link when den * intersection >= num * union of their sets.
    """
    spark = docs.sparkSession
    if order_bits is None:
        order_bits = min(MOST_BITS, ORDER_BITS + max(0, docs.count() - 1 >> 20).bit_length())
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = keep(docs.mapInArrow(_facts(k, order_bits), f"doc_id {kind}, n long, c1 long, c2 long, block int, counts binary"))
    facts = both.where("block is null").select("doc_id", "n", "c1", "c2")
    blocks = both.where("block >= 0").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(_add_blocks, "block int, counts binary").collect()  # BLOCKS rows
    if not blocks:
        return facts.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    often = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(blocks, key=lambda r: r["block"])])
    frequent = both.where("block = -1").groupBy(F.col("c1").alias("h")).agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "h").limit(HEAVY).toPandas()  # HEAVY rows at most
    heavy = frequent["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(heavy)
    heavy, times = heavy[order], frequent["times"].to_numpy(np.int64)[order]
    often = often - np.bincount((heavy >> np.uint64(64 - order_bits)).astype(np.int64), times, len(often)).astype(np.int64)  # of all others
    shared = spark.sparkContext.broadcast((often, heavy, times))
    linked = facts.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    reps = classes.select("rep", "c1", "c2")
    found = docs.mapInArrow(_prefixes(shared, k, num, den), f"doc_id {kind}, n long, c1 long, c2 long, tokens array<long>, spans binary")
    found = keep(found.withColumnRenamed("doc_id", "rep").join(reps, ["rep", "c1", "c2"], "left_semi").select("rep", "n", "tokens", "spans"))
    placed = found.select("rep", F.col("n").cast("int").alias("n"), F.posexplode("tokens").alias("pos", "token")).repartition("token")
    shared_tokens = placed.groupBy("token").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first != last").select("token")
    members = keep(placed.join(shared_tokens, "token").select("token", "rep", "n", "pos"))
    spans = found.select("rep", "spans")

    def candidates(rows: DataFrame) -> DataFrame:
        """Rows (a, na, pa, b, nb, pb) that pass the filters, each pair once."""
        needed = F.ceil((F.col("na") + F.col("nb")) * F.lit(num) / F.lit(num + den))  # of equal tokens, for the similarity
        rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        near = (F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (rest >= needed)
        pairs = rows.where(near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both_spans = pairs.join(spans.select(F.col("rep").alias("a"), F.col("spans").alias("spans_a")), "a").join(spans.select(F.col("rep").alias("b"), F.col("spans").alias("spans_b")), "b")
        return keep(both_spans.select("a", "b", "spans_a", "spans_b").mapInArrow(_suffix_filter(num, den), f"a {kind}, b {kind}").distinct())

    links: DataFrame | None = None
    checked: DataFrame | None = None

    def labelled(rows: DataFrame) -> DataFrame:
        """Group members with a label of what they are connected to so far; only of groups with more than one label."""
        if links is not None:
            labels = nearby_labels(links)
            rows = rows.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
            split_groups = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("token")
            return keep(rows.join(split_groups, "token").select("token", "rep", "n", "pos", "comp"))
        return rows.withColumn("comp", F.col("rep"))

    def settle(pairs: DataFrame) -> None:
        nonlocal links, checked
        if checked is not None:
            pairs = keep(pairs.join(checked, ["a", "b"], "left_anti"))
        new = keep(similar_pairs(pairs, docs, k, num, den).select("a", "b").distinct())
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = new if links is None else links.unionByName(new)

    for round_ in range(hub_rounds):
        members = labelled(members.drop("comp"))
        rank = F.struct(F.lit(0).cast("long"), "rep") if round_ == 0 else F.struct(F.xxhash64(F.lit(round_), "rep"), F.col("rep"))
        hub = members.groupBy("token").agg(F.min_by(F.struct("rep", "n", "pos", "comp"), rank).alias("hub"))
        met = members.join(hub, "token").where("comp != hub.comp")
        pairs = candidates(met.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("hub.rep").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.pos").alias("pb")))
        settle(pairs)
    members = labelled(members.drop("comp"))
    if not members.isEmpty():
        largest = members.groupBy("token", "comp").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"))
        outside = members.join(largest, "token").where("comp != largest")
        left = outside.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("comp_a"), "largest")
        right = members.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("comp_b"))
        met = left.join(right, "token").where("comp_a != comp_b and (comp_b = largest or a < b)")
        settle(candidates(met.select("a", "na", "pa", "b", "nb", "pb")))
    edges = links.select("a", "b") if links is not None else classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    # Rows of one doc_id with different texts are one node of several classes.
    several = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "c1", "c2")).alias("low"), F.max(F.struct("n", "c1", "c2")).alias("high")).where("low != high").select("doc_id")
    several = keep(several)
    some = not several.isEmpty()
    if some:
        edges = edges.unionByName(linked.join(several, "doc_id", "left_semi").join(classes, ["c1", "c2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = keep(components(edges))
    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).where("size > 1 or component != rep")
    # A class may have a share of all rows: its members are dealt over SALTS keys.
    dealt = named.select("c1", "c2", "n", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = facts.withColumn("salt", F.pmod(F.xxhash64(F.lit("deal"), "doc_id"), F.lit(SALTS)).cast("int")).join(dealt, ["c1", "c2", "n", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    if some:
        own = final.join(several, final["id"] == several["doc_id"], "left_semi")
        rows = rows.join(own, rows["doc_id"] == own["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return rows


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id.

    Of several rows of that id the one with the smallest hash of all its columns
    stays. Rows with a null doc_id stay as they are.
    """
    heads = join_classes(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("_id"), F.xxhash64(*docs.columns).alias("_row"))
    best = rows.where("_id is not null").groupBy("_id").agg(F.min("_row").alias("_row")).join(heads, "_id")
    kept = rows.join(best, ["_id", "_row"], "left_semi").dropDuplicates(["_id"])
    return kept.select("whole.*").unionByName(docs.where("doc_id is null"))


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: four-word shingles of whole texts, similarity 0.85."""
    return join_classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
