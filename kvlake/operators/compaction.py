"""Compaction, garbage collection, and the algebra of file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.ordered import HOT_ROWS, join_per_key
from kvlake.sources.tables import DELETION, VALUE

#: Fixed limits: files of level 0, bytes of a level (times level + 1), and the last level.
L0_FILES, LEVEL_BYTES, LAST_LEVEL = 10, 80 << 20, 3


def merge_inputs(log: DataFrame, oldest: int = 0, point=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What one compaction keeps of its inputs: no deletion, nothing a deletion hides, nothing older than `oldest`, keys from `point` on.

    How far the deletions of a key hide is a grouped maximum with partial results, joined back: no key's versions are gathered.
    """
    rows = log if point is None else log.where(F.col("k") >= F.lit(point))
    hidden_to = F.max(F.when(F.col("flag") == DELETION, F.col("v")))
    per_key = rows.groupBy("k").agg(F.coalesce(hidden_to, F.lit(-1)).alias("_hidden"), F.count("*").alias("_n"))
    live = join_per_key(rows.where((F.col("flag") == VALUE) & (F.col("v") >= oldest)), per_key, hot_rows)
    return live.where(F.col("v") > F.col("_hidden")).select(*log.columns)


def collect_garbage(log: DataFrame, horizon: int, full: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records that reads at snapshots from the horizon on can see.

    Of each key what is newer than the horizon, and the newest of the rest; that one
    goes too if it is a deletion and the log holds all older records (`full`).
    """
    per_key = log.groupBy("k").agg(F.coalesce(F.max(F.when(F.col("v") <= horizon, F.col("v"))), F.lit(-1)).alias("_at"), F.count("*").alias("_n"))
    newest = F.col("v") == F.col("_at")
    if full:
        newest = newest & (F.col("flag") == VALUE)
    return join_per_key(log, per_key, hot_rows).where((F.col("v") > horizon) | newest).select(*log.columns)


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").cast("long").alias("bytes"))


def needs_compaction(files: DataFrame, l0_files: int = L0_FILES, level_bytes: int = LEVEL_BYTES) -> DataFrame:
    """Levels over a limit: level 0 by files or bytes, level i by level_bytes * (i + 1)."""
    over = (F.col("bytes") > (F.col("level") + 1) * level_bytes) | ((F.col("level") == 0) & (F.col("n_files") > l0_files))
    return level_stats(files).where(over & (F.col("level") <= LAST_LEVEL))


def pick_newest_half(files: DataFrame) -> DataFrame:
    """Level 0 by count: the newer half of its files, to level 1."""
    w = Window.partitionBy("level")
    rows = files.where("level = 0").withColumn("_place", F.row_number().over(w.orderBy(F.col("ctime").desc(), F.col("number").desc()))).withColumn("_n", F.count("*").over(w))
    return rows.where(F.col("_place") <= F.floor(F.col("_n") / 2)).drop("_place", "_n").withColumn("target", F.lit(1))


def pick_largest(files: DataFrame) -> DataFrame:
    """Level 0 by bytes: its largest file, to level 1."""
    return files.where("level = 0").orderBy(F.col("size").desc(), "number").limit(1).withColumn("target", F.lit(1))


def pick_level(files: DataFrame, level_bytes: int = LEVEL_BYTES) -> DataFrame:
    """All files of the first level from 1 on that is over its limit, to the next one (the last to itself)."""
    over = level_stats(files).where(F.col("level").between(1, LAST_LEVEL) & (F.col("bytes") > (F.col("level") + 1) * level_bytes))
    return files.join(F.broadcast(over.agg(F.min("level").alias("level"))), "level", "left_semi").withColumn("target", F.least(F.col("level") + 1, F.lit(LAST_LEVEL)))


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records and bytes in and out, one row."""
    size = F.sum(F.octet_length(F.col("k").cast("string")) + 8 + F.octet_length(F.col("val").cast("string"))).cast("long")
    stats = lambda df, name: df.agg(F.count("*").alias(f"n_{name}"), F.coalesce(size, F.lit(0)).alias(f"bytes_{name}"))
    return stats(before, "in").crossJoin(stats(after, "out"))  # two rows of one


def apply_patch(files: DataFrame, deletes: DataFrame, creates: DataFrame) -> DataFrame:
    """(files without deletes) and creates; a file both deleted and created is created."""
    key = ["level", "number"]
    return files.join(deletes.select(*key), key, "left_anti").join(creates.select(*key), key, "left_anti").unionByName(creates)


def fold_manifest(patches: DataFrame, fields: list[str]) -> DataFrame:
    """The last set value of each field over all patches in the order of seq."""
    return patches.agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def obsolete(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Numbered files of the listing (name) whose number is not live (number)."""
    return named(listing).where("kind in ('log', 'table', 'manifest')").join(live.select("number").distinct(), "number", "left_anti")


def named(listing: DataFrame) -> DataFrame:
    """The listing with the kind and number that a file's name tells."""
    n = F.col("name")
    kind = F.when(n == "LOCK", "lock").when(n == "CURRENT", "current").when(n.rlike(r"^MANIFEST-[0-9]+$"), "manifest").when(n.rlike(r"^[0-9]+\.log$"), "log").when(n.rlike(r"^[0-9]+\.sst$"), "table").otherwise("unknown")
    return listing.withColumn("kind", kind).withColumn("number", F.when(F.col("kind").isin("manifest", "log", "table"), F.regexp_extract(n, "([0-9]+)", 1).try_cast("long")))


def files_with(files: DataFrame, key) -> DataFrame:
    """Files whose key range holds the key."""
    return files.where(F.lit(key).between(F.col("smallest"), F.col("largest")))


def purge_version(log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log without the given (k, v), and the removed records."""
    return log.join(gone.select("k", "v"), ["k", "v"], "left_anti"), log.join(gone.select("k", "v"), ["k", "v"], "left_semi")


def purge_step(log: DataFrame, cursor, horizon: int, size: int = 100) -> DataFrame:
    """The records after the cursor key that one bounded purge looks at and would remove."""
    looked = log.where(F.col("k") > F.lit(cursor)).orderBy("k", F.col("v").desc()).limit(size)
    keys = F.broadcast(looked.select("k").distinct())  # size rows at most
    keep = collect_garbage(log.join(keys, "k", "left_semi"), horizon).select("k", "v")
    return looked.join(keep, ["k", "v"], "left_anti")
