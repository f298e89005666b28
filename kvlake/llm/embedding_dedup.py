"""Operator 3: embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors of a label form a class. In each tree, the classes of a label (and
dimension) are split in two at the median of a random projection, again and again
while a node has more than LEAF classes; the direction is drawn for each tree and
level. Classes closer to the median than the spill margin go to both sides, so a
close pair is parted only if the split falls between two points further apart
along the direction than twice the margin. Splits run on all nodes of all trees of
a level at once, as grouped medians and a join. Vectors are compared by exact
cosine with all others of their leaf, in tasks of bounded blocks: a node that can't
be parted (most of it alike, and more than a leaf holds) is compared block by block, whole,
as each of its vectors may link with each other and n_links counts them all.

A pair found in several leaves counts in the first of them only, which both sides
know from their lists of leaves; so links are counted without listing pairs, and
a leaf reports one row for each class that links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing: n_links 0, component_id the vec_id;
vectors of different dimension don't link; rows with equal vectors and labels link
with each other; rows of the same vec_id are vectors of their own; a null vec_id is
never a component's id; projections that tie with a median go to both sides; an empty table gives no rows; other columns pass by unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm.common import components, keep, table

COSINE = 0.98
TREES, LEAF, LEVELS, SEED = 5, 384, 24, 11
#: Vectors of one side of a block; a task compares two blocks at most, TILE by TILE vectors at once.
#: A node that can't be parted sends each vector to one task for each of its blocks, so blocks are large.
BLOCK, TILE = 8192, 1024
#: Keys over which the rows of a class are dealt.
SALTS = 8
#: The spill margin, in standard deviations of the projected difference of a pair at COSINE.
SPILL = 1.0
#: A node is not split if so much of it is within the margin of its median: it would go to both sides.
CROWD = 0.35


def directions(dim: int) -> np.ndarray:
    """Unit vectors (TREES * LEVELS, dim), the same for each task."""
    found = np.random.default_rng((SEED, dim)).standard_normal((TREES * LEVELS, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def spill_margin(dim: int, cosine: float) -> float:
    return SPILL * math.sqrt(max(0.0, 2 - 2 * cosine) / dim)


def _project(cosine: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cid, label, vec) to a row for each tree, with the projections of its levels in units of the margin."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vec").to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vectors[i] for i in at], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                p = (x @ directions(int(dim)).T / max(spill_margin(int(dim), cosine), 1e-12)).astype(np.float32).reshape(-1, LEVELS)
                rows = pa.array(np.repeat(at, TREES))
                tree = pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(at)))
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * LEVELS), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(rows), batch.column("root").take(rows), tree, marks], ["cid", "root", "tree", "marks"])

    return project


def _together(lists: list[list[int]], a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Which of the vectors a and b are in an earlier leaf together: there the pair has been counted. Leaves are looked at in bounded numbers."""
    mine, theirs = ({v for i in at for v in lists[i] if v < leaf} for at in (a, b))
    both = sorted(mine & theirs)
    found = np.zeros((len(a), len(b)), bool)
    for start in range(0, len(both), TILE):
        number = {v: k for k, v in enumerate(both[start : start + TILE])}
        member = [np.zeros((len(at), len(number)), np.float32) for at in (a, b)]
        for side, at in zip(member, (a, b), strict=True):
            for row, i in enumerate(at):
                side[row, [k for v in lists[i] if (k := number.get(v)) is not None]] = 1
        found |= member[0] @ member[1].T > 0
    return found


def _join_labels(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (indices of rows) after the rows p and q are connected, each component's least index."""
    while True:
        x, y = label[p], label[q]
        open_ = x != y
        if not open_.any():
            return label
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def _compare(cosine: float):
    def compare(group: pa.Table) -> pa.Table:
        """One pair of blocks of a leaf: for each class that links, the vectors it newly links with, and its local component."""
        group = group.sort_by("cid")
        leaf, low, high = (group.column(c)[0].as_py() for c in ("leaf", "low", "high"))
        cid = group.column("cid").to_numpy()
        size = group.column("size").to_numpy().astype(np.int64)
        block = group.column("block").to_numpy()
        x = np.array(group.column("vec").to_pylist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = group.column("leaves").to_pylist()
        links, linked, label = np.zeros(len(cid), np.int64), np.zeros(len(cid), bool), np.arange(len(cid))
        tiles = [np.split(at, range(TILE, len(at), TILE)) for at in (np.flatnonzero(block == low), np.flatnonzero(block == high))]
        for i, a in enumerate(tiles[0]):
            for j, b in enumerate(tiles[1]):
                if low == high and j < i:
                    continue
                close = x[a] @ x[b].T >= cosine
                same = low == high and i == j
                if same:
                    np.fill_diagonal(close, False)
                pa_, pb = np.nonzero(close)
                if not len(pa_):
                    continue
                linked[a[pa_]] = linked[b[pb]] = True
                label = _join_labels(label, a[pa_], b[pb])
                new = close & ~_together(lists, a, b, leaf)
                links[a] += new @ size[b]
                if not same:
                    links[b] += new.T @ size[a]
        at = np.flatnonzero(linked)
        return pa.table({"cid": cid[at], "links": links[at], "least": cid[label[at]]})

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    # Equal up to the sign of zero: class ids are hashes of label and components.
    cid = F.when(fine, F.xxhash64(F.col("label").cast("string"), F.transform("vec", lambda v: v + 0.0)))
    rows = rows.withColumn("cid", cid)
    classes = keep(rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    root = F.xxhash64(F.col("label").cast("string"), F.size("vec"))
    level_rows = keep(classes.select("cid", root.alias("root"), "vec").mapInArrow(_project(cosine), "cid long, root long, tree int, marks array<float>").withColumn("node", F.lit(1).cast("long")))
    leaves = None
    for level in range(LEVELS):
        mark = F.col("marks")[level]
        middle = F.percentile_approx(mark, [0.5 - CROWD / 2, 0.5, 0.5 + CROWD / 2], 1000)
        nodes = level_rows.groupBy("root", "tree", "node").agg(F.count("*").alias("n"), middle.alias("q"))
        parts = (F.col("n") > LEAF) & (F.col("q")[2] - F.col("q")[0] > 2)
        nodes = keep(nodes.select("root", "tree", "node", F.col("q")[1].alias("median"), parts.alias("parts")))
        large = nodes.where("parts")
        done = level_rows.join(nodes.where("not parts").select("root", "tree", "node"), ["root", "tree", "node"], "left_semi") if not large.isEmpty() else level_rows
        done = done.select("cid", F.xxhash64("root", "tree", "node").alias("leaf"))
        leaves = keep(done if leaves is None else leaves.unionByName(done))
        if large.isEmpty():
            level_rows = None
            break
        sides = F.array_compact(F.array(F.when(mark <= F.col("median") + 1, F.col("node") * 2), F.when(mark >= F.col("median") - 1, F.col("node") * 2 + 1)))
        split = level_rows.join(large.select("root", "tree", "node", "median"), ["root", "tree", "node"])
        level_rows = keep(split.select("cid", "root", "tree", "marks", F.explode(sides).alias("node")))
    if level_rows is not None:  # what no level has split
        leaves = keep(leaves.unionByName(level_rows.select("cid", F.xxhash64("root", "tree", "node").alias("leaf"))))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    lists = leaves.groupBy("cid").agg(F.collect_list("leaf").alias("leaves"))
    places = leaves.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")).cast("int"))
    spread = places.select("cid", "leaf", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = spread.select("cid", "leaf", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    filled = classes.select("cid", "size", "vec").join(lists, "cid").join(tasks, "cid")
    found = keep(filled.groupBy("leaf", "low", "high").applyInArrow(_compare(cosine), "cid long, links long, least long"))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    heads = joined.withColumnRenamed("id", "cid").join(classes.select("cid", "first"), "cid")
    heads = heads.groupBy("component").agg(F.min("first").alias("head"))
    named = joined.join(heads, "component").select(F.col("id").alias("cid"), "head")
    known = keep(classes.select("cid", "first", "size").join(linked, "cid", "left").join(named, "cid", "left"))
    # A class of equal vectors may have a share of all rows: they are dealt over SALTS keys.
    dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select("vec_id", "cid", F.pmod(F.xxhash64(F.lit("deal"), "vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(dealt, ["cid", "salt"], "left")
    component = F.coalesce("head", "first", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the table, cosine 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (
  SELECT vec_id AS id, vec_id AS reached FROM v
  UNION SELECT r.id, p.b FROM r JOIN p ON r.reached = p.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.id LEFT JOIN n ON n.a = v.vec_id
"""
