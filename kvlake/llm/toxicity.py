"""Operator 8: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words sums, over all common subsequences of ORDER characters,
DECAY to the power of the lengths that the subsequence spans in both; gaps and
inserted characters weaken it but don't break it. It is 0 exactly where the longest
common subsequence is shorter than ORDER, so only other pairs are computed. A word's kernel with a
landmark counts as a share of the landmark's own, 1 at most, to the power of POWER (a power of a kernel is a kernel),
which tells near matches from the many faint ones; that of a sentence is the sum over its
words. Landmarks are word parts that stand in toxic training texts more often than in
others (a stem with any ending counts), and the words of other texts that come closest
to them; the Nyström map turns the comparisons with them into coordinates of a sentence,
on which a linear support vector machine is trained. A document scores by its most toxic
sentence and by its sentences' margins together, calibrated on the labelled texts.

Labels are of texts, the machine judges sentences: which sentence earned a label is learnt in
ROUNDS. At first all sentences of a text share its weight; later the one that the machine
of the round before holds most toxic stands for a toxic text, with others beyond the margin,
as far as the text is likely toxic at all (labels err), and has a share of HARD of a clean
text's weight. Near copies of a text share the weight of one text, so that words that
only copies share don't count for more.

Words are runs between white space, lower-cased (A-Z), without punctuation; a row of
three or more single letters (`i d i o t`) is a word too, and words of more than
WINDOW characters are compared window by window, so a text is used whole, whatever its length.

Defined cases: null and empty texts score as a sentence without words; unless both
labels occur all scores are 0; a null doc_id is never held out; texts that tie get
equal scores, ties between landmarks go to the greater bytes; repeated rows give
repeated results; a column _score of the input is replaced, other columns pass by unread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import SLICE_BYTES, mix, slices, table, word_hashes
from kvlake.llm.labelled import held_out, sample

ORDER, DECAY, POWER = 4, 0.7, 4
WINDOW, STEP = 24, 12
#: Comparisons below this count as 0.
LEAST = 0.001
#: Bounds of training: texts, and landmarks that tell toxic texts.
TRAIN_ROWS, LANDMARKS = 2400, 32
#: Lengths of the word parts that may be landmarks.
PARTS = range(5, 9)
#: A telling part stands so many times more often in toxic texts than in others, and in enough texts for such evidence (texts times the logarithm of that ratio).
RATIO, EVIDENCE = 5.0, 30.0
#: Rounds in which the sentences that stand for texts are chosen, and the weight of the machine's margin against its errors.
ROUNDS, REGULAR = 4, 1e-5
#: Share of a clean text's weight that its most toxic sentence has; all its sentences share the rest.
HARD = 0.8
#: Bounds up to which a document's toxic sentences count together, each a feature, and what is too faint to count.
TOTALS, FAINT = (1.0, 1.5, 2.0, 3.0), 0.3
THRESHOLD = 0.5
#: Weight of all clean texts against all toxic ones when scores are calibrated, and the penalty of squared weights.
CLEAN, RIDGE = 2.0, 1e-4
#: Margins are clipped to this range before calibration.
CLIP = (-2.0, 4.0)
#: Words known to be like no landmark are remembered up to this number in a task (8 bytes each).
REMEMBERED = 4_000_000

_MARKS = b".,;:!?\"'()[]{}<>*_~`|/\\-+=#$%&^"

def kernel(words: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """The kernel of each word, a row of character codes padded with 0, with one landmark.

    after[j] holds, for the first letters of the word so far and the first j of
    the landmark, the sum over common subsequences of one letter less.
    """
    b, n = words.shape
    m = len(landmark)
    lam = np.float32(DECAY)
    equal = [[words[:, i] == c for c in landmark] for i in range(n)]
    inner = np.ones((n + 1, m + 1, b), np.float32)
    total = np.zeros(b, np.float32)
    for level in range(1, ORDER + 1):
        if level == ORDER:
            for i in range(level, n + 1):
                for j in range(level, m + 1):
                    total += equal[i - 1][j - 1] * inner[i - 1, j - 1]
            return total * lam * lam
        after = np.zeros((n + 1, m + 1, b), np.float32)
        for i in range(level, n + 1):
            row = np.zeros(b, np.float32)
            for j in range(level, m + 1):
                row = lam * row + equal[i - 1][j - 1] * (lam * lam * inner[i - 1, j - 1])
                after[i, j] = lam * after[i - 1, j] + row
        inner = after
    return total


def _codes(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def self_kernel(word: bytes) -> float:
    return float(kernel(_codes([word], len(word)), np.frombuffer(word, np.uint8))[0])


def _alike(codes: np.ndarray, landmark: bytes) -> np.ndarray:
    """Rows of `codes` whose longest common subsequence with the landmark has ORDER characters; for all others the kernel is 0."""
    letters = np.zeros(256, np.uint8)
    masks = np.zeros(256, np.uint32)
    for k, c in enumerate(landmark):
        letters[c] = 1
        masks[c] |= np.uint32(1 << k)
    near = np.flatnonzero(letters[codes].sum(axis=1) >= ORDER)
    # The longest common subsequence, its rows as the bits of a number.
    full = np.uint32((1 << len(landmark)) - 1)
    row = np.full(len(near), full, np.uint32)
    for column in codes[near].T:
        hit = row & masks[column]
        row = ((row + hit) | (row - hit)) & full
    return near[np.bitwise_count(~row & full) >= ORDER]


def similarities(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The kernel of each word with each landmark, as a share of the landmark's own, to the power of POWER; less than LEAST is 0.

    A word longer than WINDOW has the most of its windows.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    parts, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= WINDOW:
            parts.append(w)
            owner.append(i)
        else:
            for a in range(0, len(w) - WINDOW + STEP, STEP):
                parts.append(w[a : a + WINDOW])
                owner.append(i)
    own = np.array(owner)
    sizes = np.array([len(w) for w in parts])
    for low, high in ((ORDER, 6), (7, 8), (9, 10), (11, 13), (14, 17), (18, WINDOW)):
        at = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(at):
            continue
        codes = _codes([parts[i] for i in at], int(sizes[at].max()))
        for k, landmark in enumerate(landmarks):
            near = _alike(codes, landmark)
            for a in range(0, len(near), 4096):
                part = near[a : a + 4096]
                np.maximum.at(out[:, k], own[at[part]], kernel(codes[part], np.frombuffer(landmark, np.uint8)))
    out = np.minimum(out / np.array([self_kernel(w) for w in landmarks], np.float32), 1.0) ** POWER
    out[out < LEAST] = 0
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def marked(word: bytes) -> bytes:
    """The word without punctuation, with a mark where it starts."""
    return b"^" + word.translate(None, _MARKS)


def sentence_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and their hashes; of all words of all texts, in order: which word, which sentence; of sentences: which text.

    Each text has at least one sentence. A row of single letters is put in as a
    word of its own where it ends.
    """
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = words_of(t) or [b"."]
        counts[i] = len(own)
        flat += own
    hashes, first, inverse = np.unique(word_hashes(flat), return_index=True, return_inverse=True)
    distinct = [marked(flat[i]) for i in first]
    ends = np.array([flat[i][-1:] in b".!?" for i in first])[inverse]
    ends[np.cumsum(counts) - 1] = True
    single = np.array([len(w) == 2 for w in distinct])[inverse]
    # Rows of single letters: put together into one more word, in place of the last of them.
    owner = np.repeat(np.arange(len(texts)), counts)
    change = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    inverse = inverse.copy()
    more: list[bytes] = []
    for a, b in change.reshape(-1, 2):
        for text in np.unique(owner[a:b]) if b - a >= 3 else ():
            run = np.flatnonzero(owner[a:b] == text) + a
            if len(run) >= 3:
                inverse[run[-1]] = len(distinct) + len(more)
                more.append(marked(b"".join(flat[i] for i in run)))
    hashes = np.concatenate([hashes, word_hashes(more)]) if more else hashes
    sentence = np.cumsum(ends) - ends
    return distinct + more, hashes, inverse, sentence, owner[ends]


def pooled(which: np.ndarray, sentence: np.ndarray, n: int, near: np.ndarray, similar: np.ndarray) -> np.ndarray:
    """Of each of n sentences the sum of its words' comparisons with each landmark; `similar` has the rows of the words `near`, all others are 0."""
    place = np.full(int(which.max()) + 1 if len(which) else 0, -1)
    place[near] = np.arange(len(near))
    at = np.flatnonzero(place[which] >= 0)
    out = np.zeros((n, similar.shape[1]), np.float32)
    if len(at):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sentence[at])) + 1])
        out[sentence[at[starts]]] = np.add.reduceat(similar[place[which[at]]], starts, axis=0)
    return out


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # of the kernel with each landmark, with the Nyström map multiplied in
    bias: float
    calibrated: np.ndarray  # of a document's features
    offset: float
    far: np.ndarray | None = None  # hashes of words that resemble no landmark, sorted

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The comparisons of each sentence with the landmarks, and its text."""
        distinct, hashes, which, sentence, owner = sentence_words(texts)
        if self.far is None or len(self.far) > REMEMBERED:
            self.far = np.zeros(0, np.uint64)
        at = np.searchsorted(self.far, hashes)
        known = at < len(self.far)
        known[known] = self.far[at[known]] == hashes[known]
        asked = np.flatnonzero(~known)
        similar = similarities([distinct[i] for i in asked], self.landmarks)
        near = similar.any(axis=1)
        self.far = np.union1d(self.far, hashes[asked[~near]])
        return pooled(which, sentence, len(owner), asked[near], similar[near]), owner

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, owner = self.sentences(texts)
        found = document_features(x @ self.weights + self.bias, owner, len(texts), self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(found @ self.calibrated + self.offset, -35, 35)))


def document_features(margins: np.ndarray, owner: np.ndarray, n: int, bias: float) -> np.ndarray:
    """Of each text its highest margin, and how far its sentences go beyond the bias in all, up to each of TOTALS, in widths of the margin; less than FAINT counts as nothing."""
    clipped = np.clip(margins, *CLIP)
    top = np.full(n, CLIP[0])
    np.maximum.at(top, owner, clipped)
    beyond = (clipped - bias) / 2
    total = np.bincount(owner, np.where(beyond > FAINT, beyond, 0.0), n)
    return np.column_stack([top, *(np.minimum(total, t) for t in TOTALS)])


def _parts(word: bytes) -> set[bytes]:
    return {word[a : a + n] for n in PARTS for a in range(len(word) - n + 1)}


def telling_parts(texts: list[set[bytes]], labels: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """Word parts that stand more often in toxic texts than in others, each one judged by the words that no earlier one is in.

    Where no part has enough evidence, the LANDMARKS // 4 with the most are taken.
    """
    ours, others = Counter(), Counter()
    for t, label, weight in zip(texts, labels, weights, strict=True):
        for w in t:
            (ours if label else others)[w] += weight
    toxic, clean = weights[labels == 1].sum(), weights[labels == 0].sum()
    rate = lambda mine, theirs: (mine / toxic) / ((theirs + 0.5 * min(1.0, clean / 10)) / clean)
    words = {w: n for w, n in ours.items() if rate(n, others[w]) >= 1.0}  # a common word's parts tell nothing
    inside = {w: _parts(w) for w in words}
    mine, theirs = Counter(), Counter()
    for w, n in words.items():
        for p in inside[w]:
            mine[p] += n
    worth = lambda p: mine[p] * math.log(max(1.0, rate(mine[p], theirs[p])))
    mine = Counter({p: n for p, n in mine.items() if worth(p) >= EVIDENCE}) or mine  # more than this no part can have
    for w, n in others.items():
        for p in _parts(w):
            if p in mine:
                theirs[p] += n
    enough = {p for p in mine if worth(p) >= EVIDENCE and rate(mine[p], theirs[p]) >= RATIO}
    holders: dict[bytes, list[bytes]] = {p: [] for p in enough or mine}
    for w in words:
        for p in inside[w]:
            if p in holders:
                holders[p].append(w)
    chosen: list[bytes] = []
    while holders and len(chosen) < (LANDMARKS if enough else LANDMARKS // 4):
        best = max(holders, key=lambda p: (worth(p), len(p), p))
        if enough and (worth(best) < EVIDENCE or rate(mine[best], theirs[best]) < RATIO):
            break
        chosen.append(best)
        for w in holders.pop(best):
            n = words.pop(w, 0)
            for p in inside[w] if n else ():
                mine[p] -= n
    return chosen


def copy_weights(texts: list[str]) -> np.ndarray:
    """One over the number of near copies of each text in the sample: texts that agree in three of the smallest word hashes in a row."""
    group = list(range(len(texts)))

    def head(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    seen: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        h = np.unique(word_hashes(words_of(t) or [b""]))
        least = [int(mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min()) for k in range(24)]
        for k in range(0, 24, 3):
            group[head(i)] = head(seen.setdefault((k, *least[k : k + 3]), i))
    heads = [head(i) for i in range(len(texts))]
    sizes = Counter(heads)
    return np.array([1.0 / sizes[h] for h in heads])


def separate(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the linear support vector machine with squared hinge losses: Newton steps over the rows within the margin. The last column of z is 1."""
    w = np.zeros(z.shape[1])
    ridge = REGULAR * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(40):
        inside = y * (z @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        zi, ci = z[inside], cost[inside]
        w = np.linalg.solve(ridge + (zi * ci[:, None]).T @ zi, zi.T @ (ci * y[inside]))
    return w


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Landmarks, Nyström map and support vector machine from labelled texts; None unless both labels occur."""
    toxic = np.array(labels)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    weights = copy_weights(texts)
    telling = telling_parts([{marked(w) for w in words_of(t)} for t in texts], toxic, weights) or [b"^" + b"x" * ORDER]
    # The words of other texts that come closest to the telling parts are landmarks too.
    distinct, _, which, sentence, owner = sentence_words(list(texts))
    clean_words = np.unique(which[toxic[owner[sentence]] == 0])
    closest = similarities([distinct[i] for i in clean_words], telling).max(axis=1)
    near = dict.fromkeys(distinct[clean_words[i]][:12] for i in np.argsort(-closest, kind="stable") if closest[i] > 0)
    landmarks = telling + [w for w in near if len(w) >= ORDER and w not in telling][: LANDMARKS // 4]
    gram = similarities(landmarks, landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T  # the Nyström map
    model = Model(landmarks, np.zeros(len(landmarks)), 0.0, np.zeros(len(TOTALS) + 1), 0.0)
    x, owner = model.sentences(list(texts))
    z = np.hstack([x @ root, np.ones((len(x), 1))])
    y = np.where(toxic[owner] == 1, 1.0, -1.0)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    count = np.bincount(owner, minlength=len(texts))
    share = (weights / count)[owner]
    balance = np.where(toxic == 1, weights / weights[toxic == 1].sum(), weights / weights[toxic == 0].sum())
    for round_ in range(ROUNDS):
        if round_:  # the sentences that stand for a text: the most toxic one, and of a toxic text others beyond the margin
            margins = z @ w
            _, _, likely = calibrate(document_features(margins, owner, len(texts), w[-1]), toxic, balance / 2)
            stands = (margins > 0) & (y > 0)
            stands[np.lexsort((-margins, owner))[starts]] = True
            standing = np.bincount(owner[stands], minlength=len(texts))
            share = np.where(stands, (weights * np.where(toxic == 1, likely, HARD) / standing)[owner], 0.0)
            share += np.where(y < 0, ((1 - HARD) * weights / count)[owner], 0.0)
        taken = np.flatnonzero(share)
        cost = share[taken] / np.where(y[taken] > 0, 2 * share[y > 0].sum(), 2 * share[y < 0].sum())
        w = separate(z[taken], y[taken], cost)
    model.weights, model.bias = (root @ w[:-1]).astype(np.float32), float(w[-1])
    found = document_features(x @ model.weights + model.bias, owner, len(texts), model.bias)
    model.calibrated, model.offset, _ = calibrate(found, toxic, balance * np.where(toxic == 1, 1, CLEAN) / (1 + CLEAN))
    return model


def calibrate(found: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression of the texts' labels on their features: weights, offset, and what it says of each text."""
    z = np.hstack([found, np.ones((len(found), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([*[RIDGE] * found.shape[1], 1e-9])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve(ridge + (z * (weights * p * (1 - p))[:, None]).T @ z, z.T @ ((toxic - p) * weights) - ridge @ w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1]), 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, text, label) of the bounded sample to one row: the model."""
    rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    if model:
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.landmarks], pa.list_(pa.binary())), pa.array([model.weights.astype(float).tolist()]), pa.array([model.bias]), pa.array([model.calibrated.tolist()]), pa.array([model.offset])],
            ["landmarks", "weights", "bias", "calibrated", "offset"],
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    """The model, fitted in one task over at most `rows` labelled texts (half of them toxic if there are so many)."""
    row = sample(docs, labels, label, rows, each=True).repartition(1).mapInArrow(_fit, "landmarks array<binary>, weights array<double>, bias double, calibrated array<double>, offset double").first()
    return row and Model([bytes(w) for w in row["landmarks"]], np.array(row["weights"], np.float32), row["bias"], np.array(row["calibrated"]), row["offset"])


def judge(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """The score of each text, by its most toxic sentences."""
    return np.zeros(len(texts)) if model is None else model.scores(texts).astype(float)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=4 * SLICE_BYTES):
            scored = judge(shared.value, batch.column("text").to_pylist())
            kept = [c for c, k in zip(batch.columns, batch.schema.names, strict=True) if k != "_score"]
            names = [k for k in batch.schema.names if k != "_score"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scored)], [*names, "_score"])

    return score


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with the toxicity of each text as _score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("_score").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(shared), f"{schema}, _score double")


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, whole texts."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
