"""Operators over small tables: brute force, nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import catalog, decontamination, embedding_dedup, html_extraction, licenses, mixing, ngram_join, pii, quality, secrets, toxicity
from kvlake.llm.common import components, table
from tests.oracle import SF, connect, rows_of, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (None, "some words stand here, all rights reserved. write to joe@x.org", "en", "s", 5),
    (3, "word " * 30_000, "en", "s", 150_000),
    (4, "same text twice with enough words to be a set of shingles", "en", "s", 1),
    (4, "same text twice with enough words to be a set of shingles", "en", "s", 1),
    (5, "Same text twice with enough words to be a SET of shingles", "de", None, 1),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    for c in ("id", "copy", "mix_key", "copies", "u", "label", "rep", "n", "component", "head", "_score", "spans", "base"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_queries_with_sql(spark):
    con = connect()
    for name, sql in catalog.SQL.items():
        assert rows_of(catalog.QUERIES[name](spark, SF)) == sql_rows(con, sql), name


def find_components(ids, pairs):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    pairs = {"chain": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30) if i != 7], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "empty": []}[shape]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {i for p in pairs if p[0] != p[1] for i in p}
    assert got == find_components(ids, [p for p in pairs if p[0] != p[1]])


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k, num, den, rounds", [(4, 85, 100, 1), (5, 80, 100, 0), (2, 60, 100, 2)])
def test_ngram_join_is_exact(spark, k, num, den, rounds):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        texts.append(base)
        for _ in range(rng.randint(0, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = list(enumerate(" ".join(t) for t in texts)) + [(500, ""), (501, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den, hub_rounds=rounds).collect()}
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    own = find_components(sets, links)
    assert got == {i: (len(sets[i]), own[i]) for i in sets}


def test_ngram_join_odd_rows(spark, odd, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(clashing(odd)).collect())
    assert got == Counter([(1, 0, 1), (2, 0, 2), (None, 7, None), (3, 1, 3), (4, 9, 4), (4, 9, 4), (5, 9, 4)])
    assert ngram_join.join_classes(none).count() == 0
    kept = ngram_join.keep_one(clashing(odd))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4] and kept.columns == clashing(odd).columns


def test_ngram_join_rows_of_one_id_and_a_large_class(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, text(0)) for i in range(100, 400)] + [(7, text(1)), (7, text(0)), (7, ""), (50, text(1)), (60, text(2)), (None, text(0))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 17, 7) for i in range(100, 400)} | {(7, 17, 7), (7, 0, 7), (50, 17, 7), (60, 17, 60), (None, 17, None)}


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(3000)]
    item = [rng.choice(words) for _ in range(40)]
    docs, leaks = [], set()
    for i in range(40):
        text = [rng.choice(words) for _ in range(120)]
        if i % 4 == 0:
            part = item[:25] if i % 8 else list(item)
            for _ in range(len(part) // 8):  # substitutions
                part[rng.randrange(1, len(part) - 1)] = "changed"
            text[30:30] = [w.upper() + rng.choice([",", "", "."]) for w in part]
            leaks.add(i)
        docs.append((i, " ".join(text)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (12, "!!")], "item_id long, text string")
    found = decontamination.overlaps(d, b)
    rows = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(rows) == {(i, 9) for i in leaks}
    assert all(r["doc_word"] >= 30 and 10 * r["n_equal"] >= 8 * r["n_words"] for r in rows.values())
    by_join = decontamination.overlaps(d, b, broadcast_hashes=0)
    assert rows_of(by_join) == rows_of(found)
    assert {r["doc_id"] for r in decontamination.decontaminate(d, b).collect()} == set(range(40)) - leaks


def test_decontamination_of_short_items(spark):
    rng = random.Random(3)
    items, docs, want = [], [], set()
    for n in range(1, 14):
        item = [f"q{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for c in range(12):  # so many substitutions, first and last token too
            at = set(rng.sample(range(n), rng.randint(0, min(n, n // 5 + 1)) if c else 0))
            docs.append((100 * n + c, " ".join(["before", *["other" if k in at else w for k, w in enumerate(item)], "after"])))
            if 0 not in at and n - 1 not in at and (n - len(at)) * 10 >= 8 * n:
                want.add((100 * n + c, n))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontamination.BROADCAST_HASHES, 0):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items, broadcast_hashes=bound).collect()}
        assert got == want


def plain_overlap(text, item):
    """The longest overlap over all diagonals, stretch by stretch."""
    d, q = decontamination.tokens(text.encode()), decontamination.tokens(item.encode())
    best = 0
    for shift in range(1 - len(q), len(d)):
        equal = [0 <= k + shift < len(d) and d[k + shift] == w for k, w in enumerate(q)]
        for a in range(len(q)):
            for b in range(len(q), a + best, -1):
                if equal[a] and equal[b - 1] and 10 * sum(equal[a:b]) >= 8 * (b - a):
                    best = b - a
                    break
    return best if best >= min(13, len(q)) > 0 else 0


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    items, docs = [(9000, "a " * 30), (9001, "x y")], [(9000, "a " * 60), (9001, "a b " * 30), (9002, "x y")]
    for n in range(1, 31):
        item = rng.choices(words, k=n)
        items.append((n, " ".join(item)))
        for c in range(8):
            part = item if n < 16 or c % 2 else item[(a := rng.randint(0, n - 14)) : a + 14]
            changed = rng.sample(range(len(part)), rng.randint(0, len(part) // 5)) if c else []
            docs.append((10 * n + c, " ".join([*rng.choices(words, k=20), *("other" if k in changed else w for k, w in enumerate(part)), *rng.choices(words, k=20)])))
    want = {(i, j): n for i, t in docs for j, q in items if (n := plain_overlap(t, q))}
    for bound in (decontamination.BROADCAST_HASHES, 0):
        found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_hashes=bound)
        got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in found.collect()}
        assert set(got) <= set(want) and all(n <= want[k] for k, n in got.items())
        for low, high in ((1, 8), (8, 13), (13, 16), (16, 31), (9000, 9002)):  # by length of the item
            of = [k for k in want if low <= k[1] < high]
            assert of and sum(k in got for k in of) >= (1.0 if low < 13 or low == 9000 else 0.9) * len(of)
        assert sum(got.get(k) == n for k, n in want.items()) >= 0.95 * len(want)


def test_repeats_take_no_quadratic_time():
    mine, theirs = np.full(300_000, 7, np.uint64), np.full(200, 7, np.uint64)
    assert decontamination.overlap(mine, theirs, 13, 8) == (200, 200, 0, 0)
    mine, theirs = np.tile(np.arange(5, dtype=np.uint64), 4000), np.tile(np.arange(5, dtype=np.uint64), 400)
    assert decontamination.overlap(mine, theirs, 13, 8) == (2000, 2000, 0, 0)


def test_decontamination_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(None, "same text twice with enough words to be a set of shingles"), (2, "same text twice with enough words to be a set of shingles")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(clashing(odd), b).collect()} == {(i, j) for i in (4, 5) for j in (None, 2)}
    assert decontamination.overlaps(none, b).count() == 0 and decontamination.overlaps(odd, b.limit(0)).count() == 0


@pytest.mark.parametrize("dim, n, labels", [(16, 900, 1), (64, 600, 3), (3, 200, 2)])
def test_projection_forest_against_all_pairs(spark, dim, n, labels):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((n, dim))
    for i in range(0, n - 4, 5):
        x[i + 1] = x[i] + rng.standard_normal(dim) * 0.12 * np.linalg.norm(x[i]) / np.sqrt(dim)
    x[n - 1] = x[0]
    rows = [(i, [float(v) for v in np.float32(x[i])], int((i // 5) % labels)) for i in range(n)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (y @ y.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    found = sum(g[0] for g in got.values())
    assert found <= close.sum() and found >= 0.99 * close.sum()
    own = find_components(range(n), np.argwhere(close).tolist())
    assert sum(got[i][1] == own[i] and got[i][2] == (own[i] == i) for i in range(n)) >= 0.99 * n


def test_blocks_are_compared_tile_by_tile(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(embedding_dedup, "TILE", 7)
    rng = np.random.default_rng(3)
    n = 60
    x = rng.standard_normal((n, 3))
    size = rng.integers(1, 4, n)
    lists = [sorted({99, *rng.integers(0, 200, 3).tolist()}) for _ in range(n)]
    for low, high in ((0, 0), (0, 1)):
        block = rng.integers(0, 2, n) if high else np.zeros(n, int)
        got = embedding_dedup._compare(0.9)(pa.table({"leaf": [99] * n, "low": [low] * n, "high": [high] * n, "cid": np.arange(n) * 10, "size": size, "block": block, "vec": x.tolist(), "leaves": lists}))
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j and (block[i] != block[j] or not high) and y[i] @ y[j] >= 0.9]
        links = Counter()
        for i, j in pairs:
            links[i] += 0 if {v for v in lists[i] if v < 99} & set(lists[j]) else int(size[j])
        own = find_components(range(n), pairs)
        assert {r["cid"]: (r["links"], r["least"]) for r in got.to_pylist()} == {10 * i: (links[i], 10 * own[i]) for i in {p[0] for p in pairs}}


def test_projection_forest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0, 0.0], 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (0, i) for i in (1, 2, 3, 4, 5, 6, 7, 11)} | {8: (3, 8), 9: (3, 8), 10: (3, 8), None: (3, 8)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_projection_forest_splits_a_large_alike_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 600)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((1500, 8)) + rng.standard_normal((1500, 8)) * 0.01, rng.standard_normal((300, 8))]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (y @ y.T >= 0.98).sum(axis=1) - 1
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_mixing(spark, odd, none):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 50 == 1, "rare").otherwise("big").alias("source"))
    mixed = mixing.mix(docs, {"small": 1.0, "rare": 1.0, "big": 0.0}, total=4000)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"small", "rare"} and all(abs(n - 2000) < 200 for n in counts.values())
    copies = mixed.where("source = 'rare'").groupBy("doc_id").count()
    mean, var = copies.agg(F.avg("count"), F.var_samp("count")).first()
    assert 0.6 < var / mean < 1.5 and mean > 2 * mixing.PIECE  # Poisson, by pieces
    parts = [[r["mix_key"] for r in part] for part in mixed.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)
    assert rows_of(mixed) == rows_of(mixing.mix(docs.repartition(5), {"small": 1.0, "rare": 1.0, "big": 0.0}, total=4000))
    assert mixing.left_over() < 2**-50
    out = mixing.mix(clashing(odd))
    assert set(out.columns) == set(clashing(odd).columns) and out.where("source is null").count() + out.where("source = 's'").count() == out.count()
    assert mixing.mix(none).count() == 0
    one = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, "t", "b"), (None, "t", "b")], "doc_id long, text string, source string")
    many = mixing.mix(one, {"a": 1.0, "b": 1.0}, total=160_000)  # one document to 80,000 copies, in 10,000 pieces
    counts = {r["doc_id"]: (r["n"], r["different"]) for r in many.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("different")).collect()}
    assert abs(counts[1][0] - 80_000) < 1500 and all(n == d for n, d in counts.values()) and sum(n for n, _ in counts.values()) == many.count()


def test_mixing_odd_ids_draw_on_their_own(spark):
    rows = spark.createDataFrame([(None, "s"), ("null", "s"), ("id null", "s")], "doc_id string, source string")
    keys = {r["doc_id"]: r["mix_key"] for r in mixing.mix(rows, total=60.0).where("copy = 0").collect()}
    assert len(set(keys.values())) == len(keys) == 3


def test_secrets_and_personal_data(spark, odd, none):
    for name, find in (("op4", lambda d: secrets.find_secrets(d)), ("op1", lambda d: pii.find_personal_data(d))):
        assert find(clashing(odd)).count() == len(ODD), name
        assert find(none).count() == 0, name
    rows = {r["doc_id"]: [s["kind"] for s in r["base"]] for r in pii.find_personal_data(odd).collect()}
    assert rows[None] == ["email"] and rows[1] == rows[2] == []
    out = secrets.redact_documents(spark.createDataFrame([(1, "token: abcdefgh12345678", "a", "b", 3), (2, None, "a", "b", None)], DOCS))
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "[SECRET]", 8), (2, None, None)}


def test_whole_documents_with_clashing_columns(spark, odd, none):
    b = spark.createDataFrame([(2, "same text twice with enough words to be a set of shingles")], "item_id long, text string")
    docs = clashing(odd).withColumn("leaked_id", F.lit("x")).withColumn("item_id", F.lit("x")).withColumn("clean_text", F.lit("x"))
    left = decontamination.decontaminate(docs, clashing(b))
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter([1, 2, None, 3])
    clean = secrets.redact_documents(docs)
    assert clean.columns == docs.columns and clean.where("clean_text = 'x' and spans = 'x' and base = 'x'").count() == len(ODD)
    told = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).collect()}
    assert told[None].endswith("write to [EMAIL]") and told[1] is None and told[2] == ""
    for f in (lambda d: decontamination.decontaminate(d, b), secrets.redact_documents, pii.sanitise, lambda d: ngram_join.keep_one(d)):
        assert f(none).count() == 0
    long = spark.createDataFrame([(1, "plain words of prose " * 100_000 + "pwd = xK9#mQ2$vL8w joe@x.org"), (2, "é" * 300_000)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(long).collect()} == {1: 1, 2: 0}
    assert {r["doc_id"]: len(r["spans"]) for r in pii.find_personal_data(long).collect()} == {1: 1, 2: 0}


def test_terms_that_disclose(spark):
    rows = [(i, f"common words before zanzibar joe{i % 3}@x.org common words after") for i in range(12)] + [(100 + i, "common words here and before or after other words") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: {(s["kind"], rows_text(rows, r["doc_id"])[s["start"] : s["end"]]) for s in r["spans"]} for r in pii.find_personal_data(docs).collect()}
    # zanzibar stands in 12 of 72 texts, with each address in 4: log(72*4/(12*4)) / log(72/4) = 0.62
    assert found[0] == {("email", "joe0@x.org"), ("general", "zanzibar")} and found[100] == set()
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).collect()}
    assert clean[1] == "common words before [TERM] [EMAIL] common words after"


def test_terms_that_disclose_are_marked_everywhere(spark):
    far = " other words" * 30
    rows = [(i, f"common words before zanzibar joe@x.org common words after{far} Zanzibar again" + (" quux" if i > 2 else " quux joe@x.org quux")) for i in range(8)]
    rows += [(50, f"words and zanzibar alone{far}"), *[(100 + i, "common words here and before or after other words again") for i in range(60)]]
    docs = spark.createDataFrame([*rows, (None, "null id, zanzibar"), (None, None)], "doc_id long, text string")
    for bound in (pii.BROADCAST_TERMS, 0):
        found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, broadcast_terms=bound).where("doc_id is not null").collect()}
        marked = {i: [rows_text(rows, i)[s["start"] : s["end"]] for s in spans if s["kind"] in ("general", "remove")] for i, spans in found.items()}
        # quux is near the address in 3 texts only, but stands in all 8 of its texts and nowhere else
        assert marked[0] == ["zanzibar", "Zanzibar", "quux", "quux"] and marked[7] == ["zanzibar", "Zanzibar", "quux"]
        assert marked[50] == ["zanzibar"] and marked[100] == []
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(docs).where("clean_text is not null").collect()}
    assert not any("zanzibar" in t.lower() for t in clean.values()) and len(clean) == 70


def rows_text(rows, doc_id):
    return dict(rows)[doc_id]


def plain_near(t):
    """(entity, term) for each term among the six words on either side of an entity, outside of all entities."""
    spans, found = pii.base_spans(t), set()
    for a, b, kind in spans:
        before, after = list(pii._WORD.finditer(t, 0, a)), list(pii._WORD.finditer(t, b))
        for m in before[-pii.NEAR :] + after[: pii.NEAR]:
            if len(m[0]) >= pii.TERM and not any(x < m.end() and m.start() < y for x, y, _ in spans):
                found.add((pii.entity(kind, t[a:b]), pii.term(m[0])))
    return found


def test_disclosure_of_all_documents_against_plain_counts(spark):
    planted = [(10**6 + i, f"told by zanzibar joe{i % 2}@x.org, 10.0.0.{i % 3} and qwixby" + " zanzibar" * (i % 4)) for i in range(12)] + [(2 * 10**6, "zanzibar alone")]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own, near, entities, both, terms = {}, Counter(), Counter(), Counter(), Counter()
    for i, t in texts.items():
        own[i] = {pii.entity(k, t[a:b]) for a, b, k in pii.base_spans(t)}
        words = {pii.term(w) for w in pii._WORD.findall(t)}
        entities.update(own[i])
        near.update(plain_near(t))
        terms.update(words)
        both.update({(e, w) for e in own[i] for w in words})
    n = len(texts)
    told = defaultdict(float)
    for (e, w), support in near.items():
        if support >= pii.SUPPORT and entities[e] < n:
            told[w] = max(told[w], np.log(n * both[e, w] / (terms[w] * entities[e])) / np.log(n / entities[e]))
    want = defaultdict(set)
    for i, t in texts.items():
        for m in pii._WORD.finditer(t):
            if told[pii.term(m[0])] >= pii.GENERALISE and not any(a < m.end() and m.start() < b for a, b, _ in pii.base_spans(t)):
                want[i].add(m.span())
    assert any(want.values())
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("general", "remove")} for r in pii.find_personal_data(docs).collect()}
    assert {i: s for i, s in got.items() if s} == {i: s for i, s in want.items() if s}


def test_licenses(spark, odd, none):
    texts = {
        1: "Licensed under the Apache License, Version 2.0 (the License)",
        2: "SPDX-License-Identifier: GPL-3.0-or-later",
        3: "GNU Lesser General Public License v2.1",
        4: "This is CC BY-NC-SA 4.0. CC BY, cc-by. All rights reserved; CC by",
        5: "nothing of the kind",
    }
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    labels = {i: {s["label"] for s in r["spans"] or []} for i, r in rows.items()}
    assert "apache-2.0" in labels[1]
    assert labels[2] == {"gpl-3.0"} and labels[3] == {"lgpl-2.1"} and "cc-by-nc-sa-4.0" in labels[4] and labels[5] == set()
    assert (rows[4]["places"]["cc-by"], rows[4]["places"]["reserved"], rows[4]["first_word"], rows[4]["last_word"]) == (4, 1, 2, 15)
    assert licenses.scan_licenses(clashing(odd)).count() == len(ODD) and licenses.scan_licenses(none).count() == 0
    inside = [(0, 30, 2, "a"), (5, 20, 4, "b"), (5, 20, 1, "c"), (25, 40, 5, "d"), (0, 30, 2, "a")]
    one = spark.range(1).select(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("priority"), F.lit(x).alias("label")) for a, b, p, x in inside]).alias("s"))
    assert [s["label"] for s in one.select(licenses._outermost(F.col("s")).alias("s")).first()["s"]] == ["a", "c", "d"]


LICENSE_TEXTS = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge',
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the X nor the names of its contributors may be used to endorse or promote products. Copyright (c) 1999, © 2001. Alle Rechte vorbehalten.",
    "GPL-2.0, gplv3; LGPL 2.1, Apache 2.0. MPL 1.1 mpl-2.0 and the\n\tCreative  Commons Attribution-ShareAlike 4.0 International License https://creativecommons.org/licenses/by-sa/4.0/ CC0",
    "This is free and unencumbered software released into the public domain. ruby's license, GPL'd, \"commons clause\" license condition. BSD-3-Clause; 2-clause BSD",
    "copyright 1999 " * 300,
    "licensed under the terms of the gnu general public license version 3" * 3,
]


def test_license_labels_as_by_plain_rules(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(LICENSE_TEXTS, 10**6)), "doc_id long, text string"))
    compiled = [(r, re.compile(r.pattern, re.ASCII)) for r in licenses.rules()]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] or []] for r in licenses.scan_licenses(docs).collect()}
    labels = set()
    for r in docs.collect():
        text = re.sub(r"\s+", " ", r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), flags=re.ASCII)
        found = sorted({(m.start(), -m.end(), rule.priority, f"{rule.label}-{m[1]}" if rule.versioned else rule.label) for rule, p in compiled if rule.keyword in text for m in p.finditer(text)})
        want = [s for i, s in enumerate(found) if not any(o[1] <= s[1] and o[2] <= s[2] for o in found[:i])]
        assert got[r["doc_id"]] == [(a, -b, p, label) for a, b, p, label in want], text
        labels |= {s[3] for s in want}
    assert len(labels) > 20


def test_running_results_cross_chunks(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 200)], "v array<int>")
    got = rows.select(F.transform(F.array("v"), lambda v: licenses._running(v, 0, lambda x, y: x + y))[0].alias("r")).collect()
    assert [r["r"] for r in got] == [[i * (i + 1) // 2 for i in range(n)] for n in (0, 1, 63, 64, 65, 200)]


def test_base_phrases_of_all_documents(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in catalog.QUERIES["op7_signature_rules"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r["text"].translate(low))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert got[r["doc_id"]] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(400)], LABELS)
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(["the", "of", "and", "house"], k=40)) if i % 2 else "||| bad!! foulword stench " * 6, "en", "s", 1) for i in range(400)], DOCS)
    good = quality.score(clashing(docs), quality.train(docs, labels))
    assert good.where("doc_id % 2 = 1 and _score < 0.5 or doc_id % 2 = 0 and _score > 0.5").count() == 0
    foul = toxicity.score(docs, toxicity.train(docs, labels))
    assert foul.where("doc_id % 2 = 0 and _score < 0.5 or doc_id % 2 = 1 and _score > 0.5").count() == 0
    for module in (quality, toxicity):
        model = module.train(docs, labels)
        assert module.score(odd, model).where("_score between 0 and 1").count() == len(ODD)
        assert module.score(none, model).count() == 0
        assert module.score(odd, module.train(docs, labels.limit(0))).count() == len(ODD)
    assert quality.keep_good(docs, labels).columns == docs.columns
    own = quality.keep_good(clashing(docs), labels)
    assert own.columns == clashing(docs).columns and own.where("_score = 'x'").count() == 200


@pytest.mark.parametrize("name, label, least", [("op6_ftrl_quality", "quality", 0.95), ("op8_string_kernel", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    rows = catalog.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 40 and right >= least


def test_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, "u", "<article><p>" + "Some words go here. " * 20 + "</article>")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r["page_id"]: r["n_chars"] for r in html_extraction.main_text(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == len(("Some words go here. " * 20).strip())
    assert html_extraction.main_text(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    steps = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        steps[name] = docs
        if i < 4:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    names = list(steps)
    kept = {r["doc_id"]: r["text"] for r in steps[names[0]].collect()}
    sets = {i: shingles(t, 5) for i, t in kept.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    own = find_components(sets, links)
    assert {r["doc_id"] for r in steps[names[1]].collect()} == {i for i in own if own[i] == i}
    leaked = {r["doc_id"] for r in decontamination.overlaps(steps[names[1]], table(spark, SF, "benchmark")).collect()}
    assert {r["doc_id"] for r in steps[names[2]].collect()} == {i for i in own if own[i] == i} - leaked
    assert all(not secrets.base_spans(r["text"]) for r in steps[names[3]].collect())
    assert {r["doc_id"] for r in steps[names[4]].collect()} <= {r["doc_id"] for r in steps[names[3]].collect()}
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(steps[names[4]])
