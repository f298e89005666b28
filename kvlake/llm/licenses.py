"""Operator 7: license scans by ordered signature rules, in DataFrame functions alone.

A rule (see `license_rules`) has a label, a priority, a keyword and a regular expression
over the lower-cased text with white space made single. Rules are tried only on texts that
contain their keyword; their matches are intervals. An interval inside another
one of the same or a higher priority (smaller number) is suppressed, so `licensed
under the gnu lesser general public license v2.1` does not also report the plain
GPL rule that it contains. The labels of the intervals that are left, with the
base phrases' labels, are the labels of the document.

Each rule is a literal of the plan, so its expression is compiled once in a task. Places of
matches and the reach of earlier intervals are running sums and maxima, taken in
chunks of CHUNK, so texts with very many matches take no quadratic time.

Defined cases: a null text counts as empty; an empty text has no words, no labels
(empty strings), null first_word and last_word, and score 0; very long texts are searched
whole; of equal intervals that tie in priority the one with the smaller label stays; repeated rows give repeated results; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import table
from kvlake.llm.license_rules import GRANT, LINK, MENTION, STEMS, TAG, TITLE, Rule, rules

#: Fixed base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, LINK: 0.9, TITLE: 0.8, MENTION: 0.5}
#: Length of the chunks in which running sums and maxima are taken.
CHUNK = 64


def gates(all_rules: list[Rule]) -> list[str]:
    """Few strings such that every rule's keyword contains one of them: texts without any of them match no rule."""
    out: list[str] = list(STEMS)
    for k in sorted({r.keyword for r in all_rules}, key=len):
        if not any(g in k for g in out):
            out.append(k)
    return out


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, start: int, op) -> Column:
    """Of an array (a lambda's variable) the running results of `op`, from `start` on."""
    over = lambda part, first: F.aggregate(part, first, op)
    chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
    whole = F.transform(chunks, lambda c: over(F.slice(values, c * CHUNK + 1, F.lit(CHUNK)), F.lit(start)))
    none = F.array().cast("array<int>")
    before = lambda sums: F.aggregate(sums, F.array(F.lit(start)), lambda acc, s: F.concat(acc, F.array(op(F.element_at(acc, -1), s))))
    at = F.sequence(F.lit(0), F.size(values) - 1)
    inside = lambda i: F.slice(values, i - i % CHUNK + 1, i % CHUNK + 1)
    result = _let(_let(whole, before), lambda bases: F.transform(at, lambda i: over(inside(i), F.element_at(bases, (F.floor(i / CHUNK) + 1).cast("int")))))
    return F.when(F.size(values) > 0, result).otherwise(none)


def _matches(all_rules: list[Rule]) -> Column:
    """Of the column `single` the matches of each rule that has any, and what stands before and between them, by keywords."""
    by_keyword: dict[str, list[str]] = {}
    for r in all_rules:
        pattern = "r'" + r.pattern.replace("'", r"\x27") + "'"
        versions = f"regexp_extract_all(single, {pattern}, 1)" if r.versioned else "CAST(array() AS array<string>)"
        found = f"named_struct('label', '{r.label}', 'priority', {r.priority}, 'versions', {versions}, 'hits', regexp_extract_all(single, {pattern}, 0), 'gaps', split(single, {pattern}, -1))"
        by_keyword.setdefault(r.keyword, []).append(f"CASE WHEN regexp_like(single, {pattern}) THEN {found} END")
    groups = [f"CASE WHEN contains(single, '{k}') THEN array({', '.join(own)}) ELSE array() END" for k, own in by_keyword.items()]
    return F.expr(f"array_compact(flatten(array({', '.join(groups)})))")


def _spans(found: Column) -> Column:
    """The matches of one rule as intervals."""
    hits = F.transform(found["hits"], F.length)
    # A match starts after all gaps up to it and all matches before it.
    widths = F.zip_with(F.slice(F.transform(found["gaps"], F.length), F.lit(1), F.size(hits)), F.concat(F.array(F.lit(0)), hits), lambda g, h: F.coalesce(g, F.lit(0)) + h)
    starts = lambda w: _running(F.slice(w, F.lit(1), F.size(found["hits"])), 0, lambda x, y: x + y)

    def one(start, i):
        label = F.concat_ws("-", found["label"], F.try_element_at(found["versions"], i + 1))
        return F.struct(start.alias("start"), (start + F.length(F.element_at(found["hits"], i + 1))).alias("end"), found["priority"].alias("priority"), label.alias("label"))

    return F.transform(_let(widths, starts), one)


def _outermost(spans: Column) -> Column:
    """Intervals that no other one of the same or a higher priority contains; of equal ones the first stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["label"].alias("label"))))
    # For each priority, how far the intervals of it and of higher ones reach, up to each interval.
    ends = lambda own, p: F.transform(own, lambda s: F.when(s["priority"] <= p, -s["back"]).otherwise(-1))
    reaches = lambda own: F.struct(*[_let(ends(own, p), lambda e: _running(e, -1, lambda x, y: F.greatest(x, y))).alias(f"p{p}") for p in sorted(CONFIDENCE)])

    def left(own):
        def keep(reach):
            def stays(s, i):
                # Before the interval itself: what earlier ones reach.
                far = F.coalesce(*[F.when(s["priority"] == p, F.try_element_at(reach[f"p{p}"], F.when(i > 0, i))) for p in sorted(CONFIDENCE)], F.lit(-1))
                return far < -s["back"]

            return F.filter(own, stays)

        return _let(reaches(own), keep)

    kept = _let(ordered, left)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["priority"].alias("priority"), s["label"].alias("label")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, words and base phrases counted, and `spans`: the detections that stay.

    Offsets of spans are in the lower-cased text with runs of white space as one
    space. Columns: doc_id, n_words, places (per base phrase), first_word,
    last_word, spans (start, end, priority, label).
    """
    all_rules = rules()
    separator = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # lower() changes more than A-Z: enough to tell which texts may hold a phrase or a keyword, and cheaper than translate().
    rows = rows.withColumn("loose", F.lower("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long").alias("n_words"),
        F.greatest(*[F.contains("loose", F.lit(w)) for w in dict.fromkeys(p.split()[-1] for p in PHRASES)]).alias("may_phrase"),
        F.greatest(*[F.contains("loose", F.lit(g)) for g in gates(all_rules)]).alias("may_rule"),
    )
    rows = rows.withColumn("low", F.when(F.col("may_phrase") | F.col("may_rule"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit("")))
    rows = rows.select(
        "doc_id",
        "n_words",
        # Words set apart by two spaces, so that neighbouring phrases share none; only where a phrase can be.
        F.when(F.col("may_phrase") & F.greatest(*[F.contains("low", F.lit(p.split()[0])) & F.contains("low", F.lit(p.split()[-1])) for p in PHRASES]), F.concat(F.lit(" "), F.regexp_replace("low", separator, "  "), F.lit(" "))).otherwise(F.lit("")).alias("spaced"),
        F.when(F.col("may_rule"), F.regexp_replace("low", r"\s+", " ")).otherwise(F.lit("")).alias("single"),
    )
    apart = {p: " " + p.replace(" ", "  ") + " " for p in PHRASES}
    words_in = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    places = [((F.length("spaced") - F.length(F.replace("spaced", F.lit(a), F.lit("")))) / F.lit(len(a))).cast("long").alias(PHRASES[p]) for p, a in apart.items()]
    firsts = [F.when(F.contains("spaced", F.lit(a)), words_in(F.substring_index("spaced", a, 1))) for a in apart.values()]
    lasts = [F.when(F.contains("spaced", F.lit(a)), F.col("n_words") - words_in(F.substring_index("spaced", a, -1)) - len(a.split())) for a in apart.values()]
    rows = rows.withColumn("found", F.when(F.col("single") != "", _matches(all_rules)))
    spans = F.flatten(F.transform("found", _spans))
    return rows.select(
        "doc_id",
        "n_words",
        F.struct(*places).alias("places"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.when(F.size("found") > 0, _outermost(spans)).alias("spans"),
    )


def op7_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, in whole texts."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_compact(F.array(*[F.when(F.col("places")[label] > 0, F.lit(label)) for label in PHRASES.values()]))
    own = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    best = F.array_min(F.transform("spans", lambda s: s["priority"]))
    score = F.coalesce(*[F.when(best == p, F.lit(c)) for p, c in CONFIDENCE.items()], F.when(F.size(base) > 0, F.lit(CONFIDENCE[TITLE])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        sum(F.col("places")[label] for label in PHRASES.values()).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        score.alias("score"),
    )
