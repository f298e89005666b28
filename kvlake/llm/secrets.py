"""Operator 4: secret scans with password guess costs.

Fixed patterns find assignments, access keys and hexadecimal runs. Beside them,
values that stand in a credential context (after words such as password, pwd,
bearer, or between scheme, user and host of an address) are judged by how many
guesses they would take: dynamic programming splits a value into words, dates,
repeats, keyboard walks and brute-force spans so that the sum of their costs, in
bits, is least. Values of GUESS_BITS or more are added as spans of kind `guess`:
a placeholder such as `changeme2024` is cheap, a real secret is not. Values of letters
only are judged in the same way; a word of prose in a context is cheap if it is short
or on the word list.

Offsets are code points, end exclusive. Spans are ordered by start, then kind in
the order of KINDS. Defined cases: a null text counts as empty; an empty text
has no spans and the digest of the empty string; very long texts and values are searched and
priced whole, in time linear in their length; of splits that tie in cost any gives the same bits; repeated rows give
repeated results; other columns of the input pass by unread. A value is a run of visible ASCII.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import slices, table

KINDS = ("assign", "access", "hex", "guess")
#: A value in a credential context is a secret from so many bits of guessing.
GUESS_BITS = 40.0
#: Longest block of a repeat. Values up to CACHED characters are priced once.
BLOCK, CACHED = 8, 200

# Fixed patterns of the base kinds.
_ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

# Contexts in which a value may be a credential; the value is the group. Each has one of the keys, in lower case.
_CONTEXT_KEYS = ("passphrase", "pwd", "credential", "bearer", "authorization", "key", "passcode", "password", "passwd", "secret", "token", "client_id", "signature")
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|pwd|credentials?|bearer|authorization|secret|token|(?:private|access|api)[ _-]?key|client_id|signature)"
    r"[\"']?(?:[ \t]*+(?:is[ \t]|=>|:=|[:=])|[ \t])[ \t]*+(?:(?:basic|bearer)[ \t]++)?[\"'`]?([!-~]{6,}+)",
    re.IGNORECASE | re.ASCII,
)
_ADDRESS = re.compile(r"://[^\s/:@]*+:([^\s/@]{4,}+)@")

# Word list of common passwords and names, in order of how early they are guessed.
_COMMON = """password admin welcome letmein qwerty secret changeme default login root test guest user master dragon monkey
shadow sunshine princess football baseball superman batman trustno iloveyou hello freedom whatever love ninja summer winter
spring autumn example sample dummy placeholder your key token value none null true false string here insert todo
michael jennifer thomas jordan hunter ranger buster george charlie andrew michelle jessica pepper daniel joshua maggie
computer internet server database production staging access private public company office samsung google secure system
manager account service client pass word god money orange banana apple cheese flower purple yellow silver golden tiger
eagle lion wolf the and for with from this that not are was have new old my""".split()
# Long words of prose and endings, guessed after those; shorter words are cheap in any case.
_PROSE = """tion sion ment ness able ible ings ship ally ated ates izer ization
management authentication authorization authorisation protected protection required requirements parameter parameters
embedding embeddings generation generator generated validation validator verification verifier verified expiration expired
expires exchange encryption encrypted decryption encoding configuration configured credentials credential information
provider providers available necessary mandatory important different following according algorithm algorithms
cryptography cryptographic certificate certificates signature signatures structure structures interface interfaces
reference references documentation documents application applications development developer developers environment
environments production deployment infrastructure permission permissions requested requests responses response
revocation revoked rotation rotating recovery resetting remembered forgotten complexity strength security securely
confidential classified ingredient ingredients relationship relationships agreement agreements operation operations
organization organisation government intelligence identifier identifiers identification identity attribute attributes
governance controlled controller compliance compromised vulnerability vulnerabilities transmitted transmission transaction
transactions classification sequence sequences prediction predictions probability probabilities vocabulary limitations
integration integrations endpoints specification standards technology technologies description describes described
definition definitions collection collections container containers distribution distributed duplicated automatically
previously separately correctly incorrect incorrectly invalid currently originally typically generally especially
sometimes something everything everybody everyone themselves themselves yourself ourselves otherwise therefore however
whether together understand understanding understood knowledge discovered discovery mysterious passageway passages
chambers societies admirer recipes question questions personal temporary permanent protocols mechanism mechanisms
approach approaches experience experiences communication communications characters character alphanumeric uppercase
lowercase minimum maximum length includes including contains containing provided providing accepted accepting rejected
storage stored encrypting hashing plaintext cleartext undefined unspecified unauthorized unauthenticated forbidden""".split()
_RANK = {w: i + 2 for i, w in reversed(list(enumerate(dict.fromkeys(_COMMON + _PROSE))))}
_LONGEST = max(map(len, _RANK))
_PLAIN = str.maketrans("@4301!5$7", "aaeolisst")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)?\d\d)")


def _brute(value: str) -> list[float]:
    """Bits of each character if guessed alone, by the alphabet that the value uses."""
    alphabet = 10 * bool(re.search(r"[0-9]", value)) + 26 * bool(re.search(r"[a-z]", value)) + 26 * bool(re.search(r"[A-Z]", value)) + 33 * bool(re.search(r"[^0-9A-Za-z]", value))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        alphabet = 10 if value.isdigit() else 16
    return [math.log2(max(2, alphabet))] * len(value)


def _case_bits(part: str) -> float:
    """Bits for the upper-case letters of a word: none, first, all, or any."""
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 0.0
    if upper == len(part) or (upper == 1 and (part[0].isupper() or part[-1].isupper())):
        return 1.0
    return math.log2(sum(math.comb(len(part), k) for k in range(1, min(upper, len(part) - upper) + 1)) or 1) + 1


def guess_bits(value: str, limit: float = GUESS_BITS) -> float:
    """The least sum of bits over all ways to split the value into guessable spans; of a long value, a lower bound once that has reached the limit."""
    return _cached_bits(value, limit) if len(value) <= CACHED else _least_bits(value, limit)


def _least_bits(value: str, limit: float) -> float:
    n, lower = len(value), value.lower()
    plain = lower.translate(_PLAIN)
    brute, best = _brute(value), [math.inf] * (n + 1)
    best[0] = 0.0
    # Repeats that may go on, by block size and phase: (start, bits before and of the block), worse ones left out.
    streak = [0] * (BLOCK + 1)
    repeats: list[list[list[tuple[int, float]]]] = [[[] for _ in range(size)] for size in range(BLOCK + 1)]

    def add(start: int, end: int, bits: float) -> None:
        best[end] = min(best[end], best[start] + bits + 1.0)

    for a in range(n):
        for size in range(1, min(BLOCK, a - 1) + 1):  # repeats of a block, that end here
            streak[size] = streak[size] + 1 if lower[a - 1] == lower[a - 1 - size] else 0
            _repeat(value, a, size, streak[size], repeats[size][a % size], best, limit)
        if a >= 64 and a & (a - 1) == 0:  # no way on is cheaper than the cheapest way to here or beyond
            least = min(min(best[a - 2 * BLOCK :]), *(w for sizes in repeats for phase in sizes for _, w in phase), math.inf)
            if least >= limit:
                return least
        best[a + 1] = min(best[a + 1], best[a] + brute[a])
        for b in range(a + 2, min(n, a + _LONGEST) + 1):  # words, also written with digits for letters
            for spelt, more in ((lower[a:b], 0.0), (plain[a:b], 1.0)):
                if rank := _RANK.get(spelt):
                    add(a, b, math.log2(rank) + _case_bits(value[a:b]) + more)
        if m := _DATE.match(value, a):  # dates: years close to now are guessed first
            add(a, m.end(), {4: 7.0}.get(m.end() - a, 15.5))
        b, turns = a + 1, 0
        step = None
        while b < n and lower[b] in _AT and lower[b - 1] in _AT and (n <= 64 or 2.6 * turns < limit):  # walks over neighbouring keys
            move = (_AT[lower[b]][0] - _AT[lower[b - 1]][0], _AT[lower[b]][1] - _AT[lower[b - 1]][1])
            if abs(move[0]) > 1 or abs(move[1]) > 1 or move == (0, 0):
                break
            turns += move != step
            step, b = move, b + 1
            if b - a >= 3:
                add(a, b, math.log2(47) + math.log2(b - a) + 2.6 * turns)
        b = a + 1
        while b < n and ord(lower[b]) - ord(lower[b - 1]) == (ord(lower[a + 1]) - ord(lower[a])) in (1, -1) and lower[b].isalnum():  # abc, 321
            b += 1
            if b - a >= 3:
                add(a, b, math.log2(36) + math.log2(b - a) + 1)
    for size in range(1, min(BLOCK, n - 1) + 1):
        streak[size] = streak[size] + 1 if lower[n - 1] == lower[n - 1 - size] else 0
        _repeat(value, n, size, streak[size], repeats[size][n % size], best, limit)
    return best[n]


_cached_bits = lru_cache(maxsize=50_000)(_least_bits)


def _repeat(value: str, end: int, size: int, streak: int, starts: list[tuple[int, float]], best: list[float], limit: float) -> None:
    """Price the repeats of a block of `size` that end here. `starts` has those of this phase, each worth keeping while it is the cheapest at some length."""
    if streak < size:
        starts.clear()
        return
    a = end - 2 * size
    block = value[a : a + size]
    w = best[a] + (min(size * 4.7, guess_bits(block, limit)) if size > 1 else 4.7)
    while starts and starts[-1][1] >= w:
        starts.pop()
    starts.append((a, w))
    while len(starts) > 1 and starts[-1][1] >= starts[-2][1] + math.log2((end - starts[-2][0]) / (end - starts[-1][0])):
        starts.pop()
    best[end] = min(best[end], *(w + math.log2((end - a) // size) + 1.0 for a, w in starts), math.inf)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in _ASSIGN_KEYS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def guess_spans(text: str, bits: float = GUESS_BITS) -> list[tuple[int, int, str]]:
    """Values in a credential context that take so many bits to guess."""
    found = []
    low = text.lower()
    patterns = [_CONTEXT] * any(k in low for k in _CONTEXT_KEYS) + [_ADDRESS] * ("://" in text)
    for pattern in patterns:
        for m in pattern.finditer(text):
            value = m[1].rstrip("\"'`,;.)>]}")
            if len(value) >= 6 and guess_bits(value, bits) >= bits:
                found.append((m.start(1), m.start(1) + len(value), "guess"))
    return sorted(set(found))


def _order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_ROWS_OUT = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, spans, redacted = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                fixed = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in _order(fixed)])
                found = _order(fixed + guess_spans(text))
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                if with_text:
                    redacted.append(redact(text, found))
            more = [pa.array(redacted, pa.string())] if with_text else []
            kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if with_text or n != "text"]
            names = [n for n in batch.schema.names if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base, _ROWS_OUT), pa.array(spans, _ROWS_OUT), *more], [*names, "base", "spans", *["clean_text"] * with_text])

    return scan


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by [SECRET]."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id with base and all spans (kind, start, end); with_text adds text and clean_text."""
    rows = "array<struct<kind:string,start:long,end:long>>"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text string, base {rows}, spans {rows}, clean_text string" if with_text else f"doc_id {id_type}, base {rows}, spans {rows}"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scan(with_text), schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """`docs` with secrets in `text` replaced; the other columns as they are, n_chars counted anew where present."""
    schema = docs.schema
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redact(t, _order(base_spans(t) + guess_spans(t))) for t in batch.column("text").to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    out = docs.mapInArrow(clean, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*names)
    return out


def joined(spans) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents, in whole texts."""
    found = find_secrets(table(spark, sf_dir, "documents"), with_text=False)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "guess")).cast("long").alias("n_guess"),
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    """What base_sha256 holds, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in _order(spans)).encode()).hexdigest()
