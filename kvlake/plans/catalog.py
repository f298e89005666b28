"""The registered queries on operation logs and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import bloom, hashes, scalars
from kvlake.operators import batches, compaction, cursor, merge, recovery, visible
from kvlake.operators.ordered import ranked
from kvlake.sources import tables as src
from kvlake.streaming import latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The logs as SQL.
EV = "ev AS (SELECT user_id AS k, event_id AS v, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INT AS flag, value AS val FROM events)"
ORD = "ord AS (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS k, o_orderkey AS v, (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::INT AS flag, o_totalprice AS val FROM orders)"
CUST = "cust AS (SELECT c_name AS k, c_custkey AS v, 0 AS flag, c_acctbal AS val FROM customer)"
PART = "pt AS (SELECT p_name AS k, p_partkey AS v, 0 AS flag, p_brand AS val FROM part)"
NEWEST = "newest AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1)"
LIVE = "live AS (SELECT k, v, val FROM newest WHERE flag = 0)"
LIVE_ORD = "live AS (SELECT k, v, val FROM ord WHERE flag = 0)"
RUNS = "runs AS (SELECT (number % 4)::INT AS level, number, smallest, largest, size, ctime FROM (SELECT v // 500 AS number, min(k) AS smallest, max(k) AS largest, count(*) * 64 AS size, max(v) AS ctime FROM ev GROUP BY 1))"
# Limits of a level, scaled to the size of these runs.
L0_FILES, LEVEL_BYTES = 3, 32_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _half(log: DataFrame) -> int:
    return visible.newest_version(log) // 2


def _live_orders(spark: SparkSession, d: str) -> DataFrame:
    return visible.visible(src.order_log(spark, d))


# Reading at a snapshot.


@query("latest_visible", f"WITH {EV}, {NEWEST} SELECT k, v, val FROM newest WHERE flag = 0")
def latest_visible(spark, d):
    return visible.visible(src.event_log(spark, d))


@query("snapshot_scan", f"WITH {EV} SELECT k, v, val FROM (SELECT * FROM ev WHERE v <= (SELECT max(v) // 2 FROM ev) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) WHERE flag = 0")
def snapshot_scan(spark, d):
    log = src.event_log(spark, d)
    return visible.visible(log, _half(log))


@query("point_get", f"WITH {EV}, {NEWEST} SELECT k, v, val FROM newest WHERE flag = 0 AND k = 9")
def point_get(spark, d):
    return visible.get(src.event_log(spark, d), 9)


@query("snapshot_get", f"WITH {EV} SELECT k, v, val FROM (SELECT * FROM ev WHERE k = 8 AND v <= (SELECT max(v) // 2 FROM ev) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1) WHERE flag = 0")
def snapshot_get(spark, d):
    log = src.event_log(spark, d)
    return visible.get(log, 8, _half(log))


@query("get_not_found", f"WITH {EV} SELECT k, v, val FROM ev WHERE k = -1")
def get_not_found(spark, d):
    return visible.get(src.event_log(spark, d), -1)


@query("multi_get", f"WITH {EV}, {NEWEST} SELECT k, v, val FROM newest WHERE flag = 0 AND k IN (SELECT c_custkey FROM customer)")
def multi_get(spark, d):
    keys = src.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return visible.multi_get(src.event_log(spark, d), keys)


@query("snapshot_versions", f"WITH {EV} SELECT max(v) AS version FROM ev")
def snapshot_versions(spark, d):
    return src.event_log(spark, d).agg(F.max("v").alias("version"))


@query("key_history", f"WITH {EV} SELECT *, row_number() OVER (ORDER BY v DESC) AS age FROM ev WHERE k = 8")
def key_history(spark, d):
    return visible.history(src.event_log(spark, d), 8)


@query("tombstones", f"WITH {EV} SELECT * FROM ev WHERE flag = 1")
def tombstones(spark, d):
    return visible.tombstones(src.event_log(spark, d))


@query("previous_value", f"WITH {PART} SELECT *, lag(val) OVER (PARTITION BY k ORDER BY v) AS previous FROM pt")
def previous_value(spark, d):
    return visible.previous_values(src.part_log(spark, d))


@query("upsert_existing", f"WITH {PART}, w AS (SELECT k, CASE WHEN v % 3 = 0 THEN v + 1000000 ELSE v END AS v, flag, upper(val) AS val FROM pt) SELECT w.k, w.v, w.flag, w.val, pt.v IS NOT NULL AS already_existed, pt.val AS old_value FROM w LEFT JOIN pt ON w.k = pt.k AND w.v = pt.v")
def upsert_existing(spark, d):
    log = src.part_log(spark, d)
    writes = log.select("k", F.when(F.col("v") % 3 == 0, F.col("v") + 1_000_000).otherwise(F.col("v")).alias("v"), "flag", F.upper("val").alias("val"))
    return visible.upserts(log, writes)


# Cursors.


@query("seek_first", f"WITH {ORD}, {LIVE_ORD} SELECT * FROM live ORDER BY k LIMIT 1")
def seek_first(spark, d):
    return cursor.seek_first(_live_orders(spark, d))


@query("seek_last", f"WITH {ORD}, {LIVE_ORD} SELECT * FROM live ORDER BY k DESC LIMIT 1")
def seek_last(spark, d):
    return cursor.seek_last(_live_orders(spark, d))


@query("seek", f"WITH {ORD}, {LIVE_ORD} SELECT * FROM live WHERE k >= '0000000500' ORDER BY k LIMIT 1")
def seek(spark, d):
    return cursor.seek(_live_orders(spark, d), "0000000500")


@query("seek_past_end", f"WITH {ORD}, {LIVE_ORD} SELECT * FROM live WHERE k >= 'zzz' ORDER BY k LIMIT 1")
def seek_past_end(spark, d):
    return cursor.seek(_live_orders(spark, d), "zzz")


@query("cursor_step", f"WITH {ORD}, {LIVE_ORD} SELECT 'next' AS move, * FROM (SELECT * FROM live WHERE k > '0000000500' ORDER BY k LIMIT 1) UNION ALL SELECT 'prev', * FROM (SELECT * FROM live WHERE k < '0000000500' ORDER BY k DESC LIMIT 1)")
def cursor_step(spark, d):
    rows = _live_orders(spark, d)
    return cursor.after(rows, "0000000500").select(F.lit("next").alias("move"), "*").unionByName(cursor.before(rows, "0000000500").select(F.lit("prev").alias("move"), "*"))


@query("cursor_next", f"WITH {ORD}, {LIVE_ORD} SELECT k, lead(k) OVER (ORDER BY k) AS next_k FROM live")
def cursor_next(spark, d):
    return cursor.walk(_live_orders(spark, d)).select("k", "next_k")


@query("cursor_prev", f"WITH {ORD}, {LIVE_ORD} SELECT k, lag(k) OVER (ORDER BY k) AS prev_k FROM live")
def cursor_prev(spark, d):
    return cursor.walk(_live_orders(spark, d)).select("k", "prev_k")


@query("range_scan", f"WITH {CUST} SELECT k, v, val FROM cust WHERE k >= 'Customer#000000020' AND k < 'Customer#000000090'")
def range_scan(spark, d):
    return cursor.range_scan(visible.visible(src.customer_log(spark, d)), "Customer#000000020", "Customer#000000090")


@query("prefix_scan", f"WITH {CUST} SELECT k, v, val FROM cust WHERE starts_with(k, 'Customer#0000000')")
def prefix_scan(spark, d):
    return cursor.prefix_scan(visible.visible(src.customer_log(spark, d)), "Customer#0000000")


@query("scan_limit", f"WITH {ORD}, {LIVE_ORD} SELECT * FROM live ORDER BY k LIMIT 25")
def scan_limit(spark, d):
    return cursor.limit(_live_orders(spark, d), 25)


@query("reverse_scan", f"WITH {ORD}, {LIVE_ORD} SELECT *, row_number() OVER (ORDER BY k DESC) AS rank FROM live")
def reverse_scan(spark, d):
    return cursor.scan(_live_orders(spark, d), reverse=True)


@query("seek_many", f"WITH {ORD}, {LIVE_ORD} SELECT lpad(c_custkey::VARCHAR, 10, '0') AS probe, (SELECT min(k) FROM live WHERE k >= lpad(c_custkey::VARCHAR, 10, '0')) AS found FROM customer")
def seek_many(spark, d):
    probes = src.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("probe"))
    return cursor.seek_many(_live_orders(spark, d), probes)


# Merging.

_MERGED = "SELECT k, v, flag, val, run, row_number() OVER (ORDER BY {order}) AS rank FROM ({rows})"
_BY_SEGMENT = "SELECT *, (v % 3)::INT AS run FROM ev"
_TWICE = "SELECT *, 0 AS run FROM cust UNION ALL SELECT *, 1 AS run FROM cust"


@query("merge_runs", f"WITH {EV} " + _MERGED.format(order="k, v DESC, run", rows=_BY_SEGMENT))
def merge_runs(spark, d):
    log = src.event_log(spark, d)
    return merge.merge(spark, [log.where(F.col("v") % 3 == i) for i in range(3)])


@query("merge_tie_forward", f"WITH {CUST} " + _MERGED.format(order="k, v DESC, run", rows=_TWICE))
def merge_tie_forward(spark, d):
    log = src.customer_log(spark, d)
    return merge.merge(spark, [log, log])


@query("merge_tie_reverse", f"WITH {CUST} " + _MERGED.format(order="k DESC, v, run DESC", rows=_TWICE))
def merge_tie_reverse(spark, d):
    log = src.customer_log(spark, d)
    return merge.merge(spark, [log, log], reverse=True)


@query("merge_single", f"WITH {CUST} " + _MERGED.format(order="k", rows="SELECT *, 0 AS run FROM cust"))
def merge_single(spark, d):
    return merge.merge(spark, [src.customer_log(spark, d)])


@query("merge_empty", f"WITH {CUST} SELECT k, v, flag, val, 0 AS run, 0::BIGINT AS rank FROM cust WHERE false")
def merge_empty(spark, d):
    return merge.merge(spark, [])


_AT_HALF = "half AS (SELECT * FROM ev WHERE v <= (SELECT max(v) // 2 FROM ev) QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1)"


@query("merged_visible", f"WITH {EV}, {_AT_HALF} SELECT k, v, val, row_number() OVER (ORDER BY k) AS rank FROM half WHERE flag = 0")
def merged_visible(spark, d):
    log = src.event_log(spark, d)
    return merge.merged_visible(spark, [log.where(F.col("v") % 3 == i) for i in range(3)], _half(log))


# Writing.


@query("batch_apply", f"WITH {EV} SELECT * FROM ev")
def batch_apply(spark, d):
    return batches.apply(src.batches(src.event_log(spark, d)))


@query("batch_last_wins", f"WITH {EV} SELECT v // 10 AS batch_id, k, v % 10 AS pos, flag, val FROM ev QUALIFY row_number() OVER (PARTITION BY v // 10, k ORDER BY v DESC) = 1")
def batch_last_wins(spark, d):
    return batches.last_of_batch(src.batches(src.event_log(spark, d)))


@query("delete_absent_key", f"WITH {EV}, {NEWEST} SELECT k, v, val FROM newest WHERE flag = 0")
def delete_absent_key(spark, d):
    log = src.event_log(spark, d)
    gone = spark.range(1).select(F.lit(-5).cast("long").alias("k"), F.lit(1 << 40).cast("long").alias("v"), F.lit(src.DELETION).alias("flag"), F.lit(None).cast("double").alias("val"))
    return visible.visible(log.unionByName(gone))


_BYTES = "octet_length(k::BLOB) + 8 + octet_length(val::BLOB)"


@query("memtable_bytes", f"WITH {PART} SELECT k, sum({_BYTES})::BIGINT AS bytes FROM pt GROUP BY k")
def memtable_bytes(spark, d):
    log = src.part_log(spark, d)
    return log.groupBy("k").agg(F.sum(batches.record_bytes(F.col("k"), F.col("val"))).alias("bytes"))


@query("flush_run_ids", f"WITH {PART}, s AS (SELECT *, {_BYTES} AS bytes FROM pt) SELECT k, v, flag, val, bytes::BIGINT AS bytes, (sum(bytes) OVER (ORDER BY v))::BIGINT AS written, ((sum(bytes) OVER (ORDER BY v) - bytes) // 4096)::BIGINT AS run FROM s")
def flush_run_ids(spark, d):
    return batches.flush_runs(src.part_log(spark, d), 4096)


# Compaction and file sets.

_HIDDEN = "SELECT *, coalesce(max(CASE WHEN flag = 1 THEN v END) OVER (PARTITION BY k), -1) AS hidden FROM ev"


@query("compact_merge", f"WITH {EV} SELECT k, v, flag, val FROM ({_HIDDEN}) WHERE flag = 0 AND v > hidden")
def compact_merge(spark, d):
    return compaction.merge_inputs(src.event_log(spark, d))


@query("compact_merge_oldest", f"WITH {EV} SELECT k, v, flag, val FROM ({_HIDDEN}) WHERE flag = 0 AND v > hidden AND v >= 900")
def compact_merge_oldest(spark, d):
    return compaction.merge_inputs(src.event_log(spark, d), oldest=900)


@query("compact_from_point", f"WITH {EV} SELECT k, v, flag, val FROM ({_HIDDEN}) WHERE flag = 0 AND v > hidden AND k >= 40")
def compact_from_point(spark, d):
    return compaction.merge_inputs(src.event_log(spark, d), point=40)


@query("compact_metrics", f"WITH {PART} SELECT count(*) AS n_in, sum({_BYTES})::BIGINT AS bytes_in, count(*) FILTER (v >= 100) AS n_out, (sum({_BYTES}) FILTER (v >= 100))::BIGINT AS bytes_out FROM pt")
def compact_metrics(spark, d):
    log = src.part_log(spark, d)
    return compaction.metrics(log, compaction.merge_inputs(log, oldest=100))


@query("compact_gc", f"WITH {EV}, h AS (SELECT max(v) // 2 AS h FROM ev), m AS (SELECT *, max(CASE WHEN v <= h THEN v END) OVER (PARTITION BY k) AS top FROM ev, h) SELECT k, v, flag, val FROM m WHERE v > h OR (v = top AND flag = 0)")
def compact_gc(spark, d):
    log = src.event_log(spark, d)
    return compaction.collect_garbage(log, _half(log))


def _runs(spark, d):
    return src.runs(src.event_log(spark, d))


@query("run_stats", f"WITH {EV}, {RUNS} SELECT * FROM runs")
def run_stats(spark, d):
    return _runs(spark, d)


@query("level_stats", f"WITH {EV}, {RUNS} SELECT level, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM runs GROUP BY level")
def level_stats(spark, d):
    return compaction.level_stats(_runs(spark, d))


_OVER = f"o AS (SELECT level, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM runs GROUP BY level HAVING sum(size) > (level + 1) * {LEVEL_BYTES} OR (level = 0 AND count(*) > {L0_FILES}))"


@query("needs_compaction", f"WITH {EV}, {RUNS}, {_OVER} SELECT * FROM o")
def needs_compaction(spark, d):
    return compaction.needs_compaction(_runs(spark, d), L0_FILES, LEVEL_BYTES)


@query("pick_l0_count", f"WITH {EV}, {RUNS}, z AS (SELECT *, row_number() OVER (ORDER BY ctime DESC) AS p, count(*) OVER () AS n FROM runs WHERE level = 0) SELECT level, number, smallest, largest, size, ctime, 1 AS target FROM z WHERE p <= n // 2")
def pick_l0_count(spark, d):
    return compaction.pick_newest_half(_runs(spark, d))


@query("pick_l0_size", f"WITH {EV}, {RUNS} SELECT *, 1 AS target FROM runs WHERE level = 0 ORDER BY size DESC, number LIMIT 1")
def pick_l0_size(spark, d):
    return compaction.pick_largest(_runs(spark, d))


@query("pick_level", f"WITH {EV}, {RUNS}, {_OVER} SELECT *, least(level + 1, 3)::INT AS target FROM runs WHERE level = (SELECT min(level) FROM o WHERE level >= 1)")
def pick_level(spark, d):
    return compaction.pick_level(_runs(spark, d), LEVEL_BYTES)


_DELETES = "number % 3 = 0"
_CREATES = "SELECT level, number, smallest, largest, size + 1 AS size, ctime FROM runs WHERE number % 6 = 0"


@query("fileset_apply", f"WITH {EV}, {RUNS} SELECT * FROM runs WHERE NOT ({_DELETES}) UNION ALL {_CREATES}")
def fileset_apply(spark, d):
    files = _runs(spark, d)
    return compaction.apply_patch(files, files.where(_DELETES), files.where("number % 6 = 0").withColumn("size", F.col("size") + 1))


_PATCHES = "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN event_id END AS last_version, CASE WHEN event_id % 5 = 0 THEN user_id END AS next_file, CASE WHEN event_id % 7 = 2 THEN event_type END AS comparator FROM events"


@query("manifest_fold", f"WITH p AS ({_PATCHES}) SELECT arg_max(last_version, seq) AS last_version, arg_max(next_file, seq) AS next_file, arg_max(comparator, seq) AS comparator FROM p")
def manifest_fold(spark, d):
    e = src.table(spark, d, "events")
    seq = F.col("event_id")
    patches = e.select(seq.alias("seq"), F.when(seq % 3 == 0, seq).alias("last_version"), F.when(seq % 5 == 0, F.col("user_id")).alias("next_file"), F.when(seq % 7 == 2, F.col("event_type")).alias("comparator"))
    return compaction.fold_manifest(patches, ["last_version", "next_file", "comparator"])


_LISTING = "SELECT CASE v % 5 WHEN 0 THEN 'MANIFEST-' || v WHEN 1 THEN v || '.log' WHEN 2 THEN v || '.sst' WHEN 3 THEN 'CURRENT' ELSE v || '.tmp' END AS name FROM pt"


def _listing(spark, d):
    v = F.col("v")
    name = F.when(v % 5 == 0, F.concat(F.lit("MANIFEST-"), v.cast("string"))).when(v % 5 == 1, F.concat(v.cast("string"), F.lit(".log"))).when(v % 5 == 2, F.concat(v.cast("string"), F.lit(".sst"))).when(v % 5 == 3, "CURRENT").otherwise(F.concat(v.cast("string"), F.lit(".tmp")))
    return src.part_log(spark, d).select(name.alias("name"))


_NAMED = f"SELECT name, CASE WHEN name = 'CURRENT' THEN 'current' WHEN regexp_full_match(name, 'MANIFEST-[0-9]+') THEN 'manifest' WHEN regexp_full_match(name, '[0-9]+[.]log') THEN 'log' WHEN regexp_full_match(name, '[0-9]+[.]sst') THEN 'table' ELSE 'unknown' END AS kind, CASE WHEN name = 'CURRENT' OR name LIKE '%.tmp' THEN NULL ELSE regexp_extract(name, '([0-9]+)', 1)::BIGINT END AS number FROM ({_LISTING})"


@query("file_names", f"WITH {PART} {_NAMED}")
def file_names(spark, d):
    return compaction.named(_listing(spark, d))


@query("obsolete_files", f"WITH {PART} SELECT number, name, kind FROM ({_NAMED}) WHERE number IS NOT NULL AND number NOT IN (SELECT v FROM pt WHERE v % 4 = 0)")
def obsolete_files(spark, d):
    live = src.part_log(spark, d).where("v % 4 = 0").select(F.col("v").alias("number"))
    return compaction.obsolete(_listing(spark, d), live)


@query("file_prune", f"WITH {EV}, {RUNS} SELECT * FROM runs WHERE 8 BETWEEN smallest AND largest")
def file_prune(spark, d):
    return compaction.files_with(_runs(spark, d), 8)


@query("purge_version", f"WITH {EV} SELECT k, v, flag, val, (v % 4 = 0) AS removed FROM ev")
def purge_version(spark, d):
    log = src.event_log(spark, d)
    left, gone = compaction.purge_version(log, log.where("v % 4 = 0"))
    return left.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)))


@query("purge_step", f"WITH {EV}, h AS (SELECT max(v) // 2 AS h FROM ev), m AS (SELECT *, max(CASE WHEN v <= h THEN v END) OVER (PARTITION BY k) AS top FROM ev, h), l AS (SELECT * FROM m WHERE k > 20 ORDER BY k, v DESC LIMIT 100) SELECT k, v, flag, val FROM l WHERE NOT (v > h OR (v = top AND flag = 0))")
def purge_step(spark, d):
    log = src.event_log(spark, d)
    return compaction.purge_step(log, 20, _half(log))


# Recovery.


def _fragments(spark, d):
    records = src.table(spark, d, "events").select(F.col("event_id").alias("rec"), F.concat_ws("|", "event_type", "props", F.repeat(F.col("user_id").cast("string"), 9)).alias("payload"))
    return ranked(recovery.fragments(records, 32), "rec", "part", name="pos").select("pos", "type", "payload")


@query("log_reassemble", "SELECT event_id + 1 AS rec, event_type || '|' || props || '|' || repeat(user_id::VARCHAR, 9) AS payload FROM events")
def log_reassemble(spark, d):
    return recovery.reassemble(_fragments(spark, d))


@query("log_replay", "WITH e AS (SELECT * FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND event_id > 100)) SELECT event_id AS pos, event_type AS payload, row_number() OVER (ORDER BY event_id) + 5000 AS v FROM e")
def log_replay(spark, d):
    log = src.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("payload"))
    log = log.withColumn("crc", recovery.checksum())
    torn = (F.col("payload") == "purchase") & (F.col("pos") > 100)  # bytes that changed after they were summed
    return recovery.replay(log.withColumn("payload", F.when(torn, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))), 5000).drop("crc")


@query("log_valid_prefix", "SELECT event_id AS pos, event_type FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'purchase' AND event_id > 100)")
def log_valid_prefix(spark, d):
    log = src.table(spark, d, "events").select(F.col("event_id").alias("pos"), "event_type")
    return recovery.valid_prefix(log, (F.col("event_type") == "purchase") & (F.col("pos") > 100))


# Scalars.


def _names(spark, d):
    return src.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("s"), F.concat(F.substring("p_name", 1, 3), F.col("p_brand")).alias("t"))


_N = "n AS (SELECT p_partkey AS id, p_name AS s, substr(p_name, 1, 3) || p_brand AS t FROM part)"


@query("byte_compare", f"WITH {_N} SELECT id, (CASE WHEN s < t THEN -1 WHEN s > t THEN 1 ELSE 0 END)::INT AS compared, s = t AS same FROM n")
def byte_compare(spark, d):
    return _names(spark, d).select("id", scalars.compare(F.col("s"), F.col("t")).alias("compared"), (F.col("s") == F.col("t")).alias("same"))


@query("starts_with", f"WITH {_N} SELECT id, starts_with(s, 'red') AS starts FROM n")
def starts_with(spark, d):
    return _names(spark, d).select("id", F.startswith("s", F.lit("red")).alias("starts"))


@query("remove_prefix", f"WITH {_N} SELECT id, substr(s, 4) AS rest, strlen(s)::INT AS size, ascii(substr(s, 2, 1))::INT AS second FROM n")
def remove_prefix(spark, d):
    return _names(spark, d).select("id", F.substring("s", F.lit(4), F.length("s")).alias("rest"), F.octet_length("s").alias("size"), F.ascii(F.substring("s", 2, 1)).alias("second"))


# Byte strings in hexadecimal: names, some after bytes 0xFF, and some of nothing else.
_H = "h AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'FFFFFF' WHEN id % 7 = 0 THEN 'FFFF' || hex(s) ELSE hex(s) END AS s, CASE WHEN id % 7 = 0 THEN 'FFFF' || hex(t) ELSE hex(t) END AS t FROM n)"
_AT = "substr(s, 2 * p + 1, 2)"


def _byte_names(spark, d):
    i, s, t = F.col("id"), F.hex("s"), F.hex("t")
    s = F.when(i % 11 == 0, "FFFFFF").when(i % 7 == 0, F.concat(F.lit("FFFF"), s)).otherwise(s)
    t = F.when(i % 7 == 0, F.concat(F.lit("FFFF"), t)).otherwise(t)
    return _names(spark, d).select("id", F.unhex(s).alias("s"), F.unhex(t).alias("t"))


@query(
    "shortest_separator",
    f"WITH {_N}, {_H}, p AS (SELECT *, list_min(list_filter(range(0, least(length(s), length(t)) // 2), lambda i: substr(s, 2 * i + 1, 2) <> substr(t, 2 * i + 1, 2))) AS p FROM h), q AS (SELECT *, ('0x' || {_AT})::INT AS a, ('0x' || substr(t, 2 * p + 1, 2))::INT AS b FROM p) SELECT id, CASE WHEN p IS NOT NULL AND a < 255 AND a + 1 < b THEN substr(s, 1, 2 * p) || printf('%02X', a + 1) ELSE s END AS separator FROM q",
)
def shortest_separator(spark, d):
    return _byte_names(spark, d).select("id", F.hex(scalars.shortest_separator(F.col("s"), F.col("t"))).alias("separator"))


@query(
    "short_successor",
    f"WITH {_N}, {_H}, p AS (SELECT *, list_min(list_filter(range(0, length(s) // 2), lambda i: substr(s, 2 * i + 1, 2) <> 'FF')) AS p FROM h) SELECT id, CASE WHEN p IS NULL THEN s ELSE substr(s, 1, 2 * p) || printf('%02X', ('0x' || {_AT})::INT + 1) END AS successor FROM p",
)
def short_successor(spark, d):
    return _byte_names(spark, d).select("id", F.hex(scalars.short_successor(F.col("s"))).alias("successor"))


@query("tag_codec", f"WITH {EV} SELECT k, v, (v << 8) | flag AS tag, v AS version, flag::BIGINT AS its_flag FROM ev")
def tag_codec(spark, d):
    packed = src.event_log(spark, d).withColumn("tag", scalars.tag(F.col("v"), F.col("flag")))
    return packed.select("k", "v", "tag", scalars.tag_version(F.col("tag")).alias("version"), scalars.tag_flag(F.col("tag")).alias("its_flag"))


_CODES = "list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::HUGEINT)"
_W = "4294967296"
_FOLDS = {
    "bkdr": ("0", f"(h * 131 + c) % {_W}"),
    "djb": ("5381", f"(h * 33 + c) % {_W}"),
    "js": ("1315423911", f"xor(h, ((h * 32 + c) + (h // 4)) % {_W})"),
    "elf": ("0", f"xor((h * 16 + c) % {_W}, ((h * 16 + c) % {_W} // 268435456) * 16) % 268435456"),
    "pjw": ("0", f"xor((h * 16 + c) % {_W}, ((h * 16 + c) % {_W} // 268435456) * 16) % 268435456"),
}


def _fold_sql(name: str) -> str:
    start, step = _FOLDS[name]
    return f"(list_reduce(list_prepend({start}::HUGEINT, {_CODES}), lambda h, c: {step}) % 2147483648)::BIGINT"


def _hash_sql(name: str) -> str:
    return f"WITH {_N} SELECT id, {_fold_sql(name)} AS hash FROM n"


# Folds that need more than one number, as recursive tables over n (id, s).
_RS = f"rs AS (SELECT id, s, 0 AS i, 0::HUGEINT AS h, 63689::HUGEINT AS a FROM n UNION ALL SELECT id, s, i + 1, (h * a + ascii(substr(s, i + 1, 1))) % {_W}, (a * 378551) % {_W} FROM rs WHERE i < length(s))"
_AP = f"ap AS (SELECT id, s, 0 AS i, 0::BIGINT AS h FROM n UNION ALL SELECT id, s, i + 1, xor(h, CASE WHEN i % 2 = 0 THEN xor(xor((h * 128) % {_W}, ascii(substr(s, i + 1, 1))::BIGINT), h // 8) ELSE 4294967295 - xor(xor((h * 2048) % {_W}, ascii(substr(s, i + 1, 1))::BIGINT), h // 32) END) FROM ap WHERE i < length(s))"


def _recursive_sql(table: str, sql: str) -> str:
    return f"WITH RECURSIVE {_N}, {sql} SELECT id, (h % 2147483648)::BIGINT AS hash FROM {table} WHERE i = length(s)"


def _hash_query(f) -> Query:
    return lambda spark, d: _names(spark, d).select("id", f(F.col("s")).alias("hash"))


for _name, _f in (("bkdr", hashes.bkdr), ("djb", hashes.djb), ("js", hashes.js), ("elf", hashes.elf), ("pjw", hashes.pjw)):
    query(f"hash_{_name}", _hash_sql(_name))(_hash_query(_f))
query("hash_rs", _recursive_sql("rs", _RS))(_hash_query(hashes.rs))
query("hash_ap", _recursive_sql("ap", _AP))(_hash_query(hashes.ap))


# Bit by bit, the lowest first; 3988292384 is the reversed polynomial of CRC-32.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_CODES}, lambda c: c::BIGINT)), lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2)))), 4294967295)"


@query("crc32", f"WITH {_N} SELECT id, {_CRC} AS crc FROM n")
def crc32(spark, d):
    return _names(spark, d).select("id", F.crc32(F.col("s").cast("binary")).alias("crc"))


@query("varint_size", f"WITH {EV} SELECT v, (greatest(1, ceil(length(bin(v * v * 37)) / 7)))::INT AS size FROM ev")
def varint_size(spark, d):
    return src.event_log(spark, d).select("v", scalars.varint_size(F.col("v") * F.col("v") * 37).alias("size"))


_VALUES = "n AS (SELECT event_id AS v, event_id::BIGINT * event_id * 37 AS x FROM events)"
_BYTE_OF = "printf('%02X', (((x >> (7 * i)) & 127) | CASE WHEN i > 0 THEN 128 ELSE 0 END)::INT)"


@query("varint_encode", f"WITH {_VALUES} SELECT v, array_to_string(list_transform(range(greatest(1, ceil(length(bin(x)) / 7))::BIGINT - 1, -1, -1), lambda i: {_BYTE_OF}), '') AS bytes FROM n")
def varint_encode(spark, d):
    return src.event_log(spark, d).select("v", F.hex(scalars.varint_encode(F.col("v") * F.col("v") * 37)).alias("bytes"))


@query("varint_decode", f"WITH {_VALUES} SELECT v, x AS decoded FROM n")
def varint_decode(spark, d):
    return src.event_log(spark, d).select("v", scalars.varint_decode(scalars.varint_encode(F.col("v") * F.col("v") * 37)).alias("decoded"))


@query("clz64", f"WITH {_VALUES} SELECT v, (CASE WHEN x = 0 THEN 64 ELSE 64 - length(bin(x)) END)::INT AS zeros FROM n")
def clz64(spark, d):
    return src.event_log(spark, d).select("v", scalars.leading_zeros(F.col("v") * F.col("v") * 37, 64).cast("int").alias("zeros"))


@query("ctz64", f"WITH {_VALUES} SELECT v, (CASE WHEN x = 0 THEN 64 ELSE bit_count((x & -x) - 1) END)::INT AS zeros FROM n")
def ctz64(spark, d):
    return src.event_log(spark, d).select("v", scalars.trailing_zeros(F.col("v") * F.col("v") * 37, 64).cast("int").alias("zeros"))


@query("popcount", f"WITH {EV} SELECT v, bit_count(v)::INT AS ones FROM ev")
def popcount(spark, d):
    return src.event_log(spark, d).select("v", scalars.popcount(F.col("v")).alias("ones"))


@query("clz", f"WITH {EV} SELECT v, (CASE WHEN v = 0 THEN 32 ELSE 32 - length(bin(v)) END)::INT AS zeros FROM ev")
def clz(spark, d):
    return src.event_log(spark, d).select("v", scalars.leading_zeros(F.col("v")).cast("int").alias("zeros"))


@query("ctz", f"WITH {EV} SELECT v, (CASE WHEN v = 0 THEN 32 ELSE bit_count((v & -v) - 1) END)::INT AS zeros FROM ev")
def ctz(spark, d):
    return src.event_log(spark, d).select("v", scalars.trailing_zeros(F.col("v")).cast("int").alias("zeros"))


@query("find_first_zero", f"WITH {EV}, i AS (SELECT v, 4294967295 - v AS n FROM ev) SELECT v, (CASE WHEN n = 0 THEN 32 ELSE bit_count((n & -n) - 1) END)::INT AS at FROM i")
def find_first_zero(spark, d):
    return src.event_log(spark, d).select("v", scalars.first_zero(F.col("v")).cast("int").alias("at"))


@query("align_up", f"WITH {EV} SELECT v, (ceil(v / 32) * 32)::BIGINT AS aligned, (ceil(v / 64))::BIGINT AS blocks FROM ev")
def align_up(spark, d):
    return src.event_log(spark, d).select("v", scalars.align_up(F.col("v"), 32).cast("long").alias("aligned"), F.ceil(F.col("v") / 64).cast("long").alias("blocks"))


# Filters and bitmaps.


def _offered(spark, d):
    return src.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("s"))


_BLOOM = (
    f"WITH RECURSIVE n AS (SELECT c_custkey AS id, c_name AS s FROM customer), {_RS}, {_AP}, g AS (SELECT id, [{_fold_sql('js')}, {_fold_sql('bkdr')}, {_fold_sql('elf')}] AS hs FROM n), "
    f"p AS (SELECT g.id, rs.s, unnest(list_concat(hs, [ap.h % 2147483648, (rs.h % 2147483648)::BIGINT])) % {1 << 14} AS bit "
    "FROM g JOIN rs ON rs.id = g.id AND rs.i = length(rs.s) JOIN ap ON ap.id = g.id AND ap.i = length(ap.s)), bits AS (SELECT DISTINCT bit FROM p WHERE id % 3 = 0)"
)


@query("bloom_test", f"{_BLOOM} SELECT s, bool_and(bit IN (SELECT bit FROM bits)) AS present FROM p GROUP BY s")
def bloom_test(spark, d):
    tested = src.table(spark, d, "customer").select(F.col("c_name").alias("s"))
    return bloom.test(tested, bloom.build(_offered(spark, d), 1 << 14), 1 << 14)


@query("bloom_count", f"{_BLOOM} SELECT count(*) // 5 AS n FROM bits")
def bloom_count(spark, d):
    return bloom.count(bloom.build(_offered(spark, d), 1 << 14))


@query("bitmap_count", f"WITH {EV} SELECT k // 32 AS word, count(DISTINCT k) AS bits FROM ev GROUP BY 1")
def bitmap_count(spark, d):
    return src.event_log(spark, d).select("k").distinct().groupBy(F.floor(F.col("k") / 32).alias("word")).agg(F.count("*").alias("bits"))


@query("space_ratio", f"WITH {EV} SELECT round(count(DISTINCT k) / 4096.0, 6)::DOUBLE AS ratio FROM ev")
def space_ratio(spark, d):
    return bloom.used_share(src.event_log(spark, d).select(F.col("k").alias("bit")), 4096)


@query("stream_latest", f"WITH {EV}, {NEWEST} SELECT k, v, flag, val FROM newest")
def stream_latest(spark, d):
    return latest.replay(spark, d)
