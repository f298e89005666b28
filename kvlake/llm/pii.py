"""Operator 1: personal data, with information-theoretic disclosure of terms around it.

Fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers:
the protected entities. Terms that stand near an entity may reveal it as well: those
within NEAR words of it in SUPPORT documents are candidates. Over the whole corpus it is
counted in how many documents an entity, a candidate, and both occur, anywhere in the
document. The pointwise mutual information of term and entity, as a
share of the information of the entity itself,

    disclosure = log(N * n(term, entity) / (n(term) * n(entity))) / log(N / n(entity))

is 1 for a term that stands nowhere but with the entity, and near 0 for one that is
everywhere. Where it exceeds GENERALISE the term is replaced by a general name, and
where it exceeds REMOVE it is removed: at every place of every document, near an entity
or not, by the term's highest disclosure over all entities. Estimates need support: an entity and a pair count
only from SUPPORT documents on.

Term spans have the kinds `general` and `remove`. Offsets are code points, end
exclusive; spans are ordered by start, then kind in the order of KINDS. Defined
cases: a null text counts as empty; an empty text has no spans and the digest of the
empty string; very long texts are searched whole; a disclosure that ties with a threshold
reaches it; repeated rows count as documents of their own and give repeated
results; null ids are kept; other columns of the input pass by unread.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import SLICE_BYTES, Door, bit_filter, keep, mix, slices, table
from kvlake.llm.secrets import joined

KINDS = ("email", "ip", "card", "phone", "general", "remove")
#: Terms within so many words of an entity stand with it.
NEAR = 6
#: Disclosure thresholds, and the number of documents that an estimate needs.
GENERALISE, REMOVE, SUPPORT = 0.6, 0.9, 3
#: Shortest term, in characters.
TERM = 3
#: Pairs of an entity and a term of one text that are looked up at once.
PAIRS = 1 << 20
#: Bits of the filter that lets candidate terms through when the corpus is counted; its size is fixed.
FILTER_BITS = 24
#: Telling terms are broadcast up to this number (16 bytes each); beyond it, their places come from a shuffled join.
BROADCAST_TERMS = 1_000_000

# Fixed patterns of the base kinds. An address is found from its @, as its left part only ends there.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses that don't overlap: a local part reaches back to the end of the one before."""
    found, end = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            found.append((a, m.end()))
            end = m.end()
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entity(kind: str, value: str) -> int:
    """The entity's hash: the same for other spellings of one value."""
    plain = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def term(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace")) - (1 << 63)


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def pair_hashes(entities: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """One hash for each pair of entity and term (signed, as all hashes in columns)."""
    return mix(mix(entities.view(np.uint64)) + terms.view(np.uint64)).view(np.int64)


def near_terms(text: str, spans: list[tuple[int, int, str]]) -> set[tuple[int, int]]:
    """(entity, term) for the terms within NEAR words of each entity, outside of entities.

    Words are read around each entity only, so the time grows with the entities.
    """
    found = set()
    # Where entities lie, as stretches that don't overlap: starts and ends in turn.
    edges: list[int] = []
    for a, b, _ in spans:
        if edges and a <= edges[-1]:
            edges[-1] = max(edges[-1], b)
        else:
            edges += [a, b]
    terms: dict[int, tuple[int, int | None]] = {}  # by their start: end, and hash (None inside of an entity)
    for a, b, kind in spans:
        own = entity(kind, text[a:b])
        before, size = [], 64
        while a and len(before) <= NEAR:  # look back in growing pieces until there are enough words
            size *= 2
            from_ = max(0, a - size)
            before = list(_WORD.finditer(text, from_, a))
            if from_ == 0:
                break
            before = before[1:]  # its start may be cut
        after = []
        for m in _WORD.finditer(text, b):
            after.append(m)
            if len(after) == NEAR:
                break
        for m in before[-NEAR:] + after:
            x, y = m.span()
            if y - x < TERM:
                continue
            if (known := terms.get(x)) is None or known[0] != y:
                at = bisect_left(edges, y)  # edges before the word's end; an odd number of them, or one inside, is an overlap
                outside = at % 2 == 0 and (at == 0 or edges[at - 1] <= x)
                known = terms[x] = (y, term(m[0]) if outside else None)
            if known[1] is not None:
                found.add((own, known[1]))
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))


def _find(with_text: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to base spans, the text's hash, its entities, and terms near them; with_text, the text as well."""
        for batch in slices(batches):
            base, near, held, key = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                held.append(sorted({entity(k, text[a:b]) for a, b, k in spans}))
                near.append([{"entity": e, "term": t} for e, t in near_terms(text, spans)])
                key.append(text_key(text))
            texts = batch.column("text") if with_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array(key, pa.int64()), pa.array(base, _SPANS), pa.array(held, pa.list_(pa.int64())), pa.array(near, _NEAR)], ["doc_id", "text", "text_key", "base", "entities", "near"])

    return find


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term) to the hash of the pair."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(batch.column("entity").to_numpy(), batch.column("term").to_numpy()))], ["h"])


def _filter(hashes: DataFrame, column: str) -> bytes:
    return bit_filter(hashes.select(F.col(column).alias("h")).distinct(), FILTER_BITS)


class _Candidates(dict):
    """Word to the hash of its term where the filter lets it through, else 0; bounded."""

    def __init__(self, bits: bytes):
        self.door = Door(bits)

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = term(word)
        h = self[word] = h if self.door.open[(h & (1 << 64) - 1) >> (64 - FILTER_BITS)] else 0
        return h


def _count_terms(shared):
    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to (entity, term, n): in how many of a slice's texts each candidate term stands (entity null), and each candidate pair."""
        candidates, pairs, entities = _Candidates(shared.value[0]), Door(shared.value[1]), Door(shared.value[2])
        for batch in slices(batches, size=4 * SLICE_BYTES):
            counts: dict[tuple[int | None, int], int] = {}
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                own = {h for w in set(_WORD.findall(text)) if (h := candidates[w])}
                for h in own:
                    counts[None, h] = counts.get((None, h), 0) + 1
                if own and (spans := base_spans(text)):
                    terms = np.fromiter(own, np.int64, len(own))
                    held = np.array(sorted({entity(k, text[a:b]) for a, b, k in spans}), np.int64)
                    held = held[entities.lets(held)]  # only entities of a candidate pair are paired with the text's terms
                    step = max(1, PAIRS // len(terms))
                    for i in range(0, len(held), step):
                        e = np.repeat(held[i : i + step], len(terms))
                        h = np.tile(terms, len(held[i : i + step]))
                        hit = pairs.lets(pair_hashes(e, h))
                        for pair in zip(e[hit].tolist(), h[hit].tolist(), strict=True):
                            counts[pair] = counts.get(pair, 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in counts], pa.int64()), pa.array([h for _, h in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["entity", "term", "n"])

    return count_terms


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs whose term exceeds the lower threshold."""
    spark = docs.sparkSession
    n_docs = found.count()
    near = found.where(F.size("near") > 0).select("near")
    entities = found.where(F.size("entities") > 0).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    pairs = near.select(F.explode("near").alias("p")).select("p.entity", "p.term").groupBy("entity", "term").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= SUPPORT)
    pairs = keep(pairs.join(entities, "entity").select("entity", "term", "n_entity"))
    shared = spark.sparkContext.broadcast((_filter(pairs, "term"), bit_filter(pairs.select("entity", "term").mapInArrow(_pair_rows, "h long"), FILTER_BITS), _filter(pairs, "entity")))
    counted = keep(docs.select("text").mapInArrow(_count_terms(shared), "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n")))
    terms = counted.where("entity is null").select("term", F.col("n").alias("n_term"))
    both = counted.where("entity is not null").select("entity", "term", F.col("n").alias("n_both"))
    n = F.lit(float(max(2, n_docs)))
    told = F.log(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.greatest(F.log(n / F.col("n_entity")), F.lit(1e-9))
    return pairs.join(both, ["entity", "term"]).join(terms, "term").where(F.col("n_entity") < n).select("entity", "term", F.least(told, F.lit(1.0)).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _places(shared):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to (doc_id, text_key, term, places): all places of each term that the filter lets through, outside of entities."""
        candidates = _Candidates(shared.value)
        for batch in slices(batches):
            row, key, terms, places = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text or not any(candidates[w] for w in set(_WORD.findall(text))):
                    continue
                inside = np.zeros(len(text) + 1, bool)
                for a, b, _ in base_spans(text):
                    inside[a:b] = True
                own: dict[int, list[dict[str, int]]] = {}
                for m in _WORD.finditer(text):
                    if (h := candidates[m[0]]) and not inside[m.start() : m.end()].any():
                        own.setdefault(h, []).append({"start": m.start(), "end": m.end()})
                row += [i] * len(own)
                key += [text_key(text)] * len(own)
                terms += own
                places += own.values()
            if row:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(key, pa.int64()), pa.array(terms, pa.int64()), pa.array(places, _PLACES)], ["doc_id", "text_key", "term", "places"])

    return places


def find_personal_data(docs: DataFrame, with_text: bool = False, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """doc_id, text, base spans and all spans (kind, start, end) of each row of `docs`; text is null unless asked for."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"
    found = keep(docs.mapInArrow(_find(with_text), f"doc_id {kind}, text string, text_key long, base {spans}, entities array<long>, near array<struct<entity:long,term:long>>"))
    risky = keep(disclosures(docs, found).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    n_risky = risky.limit(broadcast_terms + 1).count()
    rows = found.select("doc_id", "text", "base", F.lit(None).cast(spans).alias("added"))
    if n_risky:
        shared = spark.sparkContext.broadcast(_filter(risky, "term"))
        places = docs.mapInArrow(_places(shared), f"doc_id {kind}, text_key long, term long, places array<struct<start:long,end:long>>")
        level = F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("general")
        told = places.join(F.broadcast(risky) if n_risky <= broadcast_terms else risky, "term").select("doc_id", "text_key", F.transform("places", lambda x: F.struct(level.alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("s"))
        added = told.groupBy(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key")).agg(F.flatten(F.collect_set("s")).alias("added"))
        rows = found.join(added, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left").select("doc_id", "text", "base", "added")
    order = F.array(*[F.lit(k) for k in KINDS])
    sort_key = F.transform(F.concat("base", F.coalesce("added", F.array().cast(spans))), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("doc_id", "text", "base", F.transform(F.array_sort(sort_key), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


_NAMES = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "remove": ""}


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for s in spans or []:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], _NAMES[s["kind"]]]
                at = max(at, s["end"])
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("spans")], ["doc_id", "clean_text", "spans"])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, clean_text and spans: entities replaced by their kind, telling terms generalised or removed."""
    found = find_personal_data(docs, with_text=True).select("doc_id", "text", "spans")
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_apply, f"doc_id {kind}, clean_text string, spans array<struct<kind:string,start:long,end:long>>")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and telling terms of all documents, in whole texts."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].isin("general", "remove"))).cast("long").alias("n_terms"),
    )
