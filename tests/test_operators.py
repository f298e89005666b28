import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.functions import bloom, hashes, scalars
from kvlake.operators import batches, compaction, cursor, merge, ordered, recovery, visible


LOG = "k string, v long, flag int, val string"
HISTORY = [("aaa", 1, 0, "1"), ("aaa", 2, 1, "2"), ("aaa", 3, 0, "3")]


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def values(df):
    return [r["val"] for r in df.orderBy("k").collect()]


@pytest.mark.parametrize("snapshot, value", [(9, ["3"]), (1, ["1"]), (2, []), (0, [])])
def test_history_with_tombstone(spark, snapshot, value):
    assert values(visible.get(log(spark, HISTORY), "aaa", snapshot)) == value


def test_deleted_in_a_newer_run_stays_hidden(spark):
    old, new = log(spark, [("a", 0, 0, "1"), ("b", 1, 0, "1")]), log(spark, [("a", 2, 1, "")])
    assert [r["k"] for r in visible.visible(merge.union_runs([old, new])).collect()] == ["b"]


def test_merge_runs(spark):
    def runs(*sets):
        return [log(spark, [(k, i, 0, "") for i, k in enumerate(s)]) for s in sets]

    keys = lambda df: [r["k"] for r in df.orderBy("rank").collect()]
    assert keys(merge.merge(spark, runs(["a", "aaa", "aaaaa"], ["aa", "aaaa", "aaaaaa"]))) == ["a" * i for i in range(1, 7)]
    assert keys(merge.merge(spark, runs(["cc", "ccc"], ["c", "cccc"], ["ccccc", "cccccc"]), reverse=True)) == ["c" * i for i in range(6, 0, -1)]
    assert merge.merge(spark, []).count() == 0


def test_compaction_with_deletions(spark):
    first = log(spark, [("a", 0, 0, "1"), ("aaa", 2, 1, "3"), ("aaaaa", 4, 0, "5")])
    second = log(spark, [("aa", 1, 0, "2"), ("aaaa", 3, 1, "4"), ("aaaaaa", 5, 0, "6")])
    kept = compaction.merge_inputs(first.unionByName(second))
    assert [r["k"] for r in kept.orderBy("k").collect()] == ["a", "aa", "aaaaa", "aaaaaa"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["", "a", "b", "cc"]), st.booleans()), max_size=12), st.integers(-1, 12))
def test_garbage_collection_keeps_every_read(spark, ops, horizon):
    rows = [(k, i, int(dead), str(i)) for i, (k, dead) in enumerate(ops)]
    whole = log(spark, rows)
    kept = [tuple(r) for r in compaction.collect_garbage(whole, horizon).collect()]
    for snapshot in range(max(horizon, 0), 13):

        def read(records):
            state = {}
            for k, v, flag, val in sorted(records, key=lambda r: r[1]):
                if v <= snapshot:
                    state[k] = None if flag else val
            return {k: v for k, v in state.items() if v is not None}

        assert read(kept) == read(rows)


def test_batches_number_versions(spark):
    made = spark.createDataFrame([(0, [(0, "a", "1"), (1, "a", "")]), (1, []), (2, [(0, "b", "2")])], "batch_id long, ops array<struct<op:int,key:string,value:string>>")
    rows = batches.apply(made, 1).orderBy("v").collect()
    assert [(r["k"], r["v"], r["flag"]) for r in rows] == [("a", 1, 0), ("a", 2, 1), ("b", 3, 0)]
    assert {(r["batch_id"], r["k"]): r["flag"] for r in batches.last_of_batch(made).collect()} == {(0, "a"): 1, (2, "b"): 0}


def test_order_helpers_cross_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r["k"], r["rank"]) for r in ordered.ranked(rows, "k").orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    summed = {r["k"]: r["running"] for r in ordered.running_sum(rows, "k", "k").collect()}
    assert summed == {i: i * (i + 1) // 2 for i in range(1000)}
    probes = spark.createDataFrame([(-5,), (500,), (999,), (1000,)], "probe long")
    assert {r["probe"]: r["found"] for r in cursor.seek_many(rows, probes).collect()} == {-5: 0, 500: 500, 999: 999, 1000: None}


def test_recovery_round_trip(spark):
    records = spark.createDataFrame([(1, "a" * 32), (2, "b"), (3, ""), (4, "c" * 100)], "rec long, payload string")
    cut = ordered.ranked(recovery.fragments(records, 32), "rec", "part", name="pos")
    assert [r["payload"] for r in recovery.reassemble(cut).orderBy("rec").collect()] == ["a" * 32, "b", "", "c" * 100]


def test_file_sets(spark):
    schema = "level int, number long, smallest string, largest string, size long, ctime long"
    files = spark.createDataFrame([(1, 2, "aaaa", "cccc", 1024, 0), (2, 4, "dddd", "ffff", 1024, 1)], schema)
    made = spark.createDataFrame([(1, 2, "aaaa", "bbbb", 10, 5)], schema)
    after = compaction.apply_patch(files, files.where("number = 2"), made)
    assert {(r["level"], r["number"], r["size"]) for r in after.collect()} == {(1, 2, 10), (2, 4, 1024)}
    assert [r["number"] for r in compaction.files_with(files, "eeee").collect()] == [4]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    n = lambda x: F.lit(x).cast("long")
    assert [value(scalars.varint_size(n(x))) for x in (0, 1, 64, 127, 128, 1 << 28)] == [1, 1, 1, 1, 2, 5]
    assert [value(scalars.first_zero(n(x))) for x in (0, 1, 3, 0xFFFFFFFF, 0xFFFFFFEF, 0xFFFFEFFF, 0xFEFFFFFF)] == [0, 1, 2, 32, 4, 12, 24]
    assert [value(scalars.trailing_zeros(n(x))) for x in (0, 1 << 31, 0x80008000, 8)] == [32, 31, 15, 3]
    assert [value(scalars.align_up(n(x), 32)) for x in (0, 32, 31)] == [0, 32, 32]
    assert value(F.crc32(F.lit("123456789").cast("binary"))) == zlib.crc32(b"123456789")
    assert value(hashes.bkdr(F.lit("abc"))) == 1677554
    separator = lambda a, b: bytes(value(scalars.shortest_separator(F.lit(bytearray(a)), F.lit(bytearray(b)))))
    assert [separator(a, b) for a, b in ((b"abc1", b"abz"), (b"a\xfe1", b"a\xff"), (b"ab", b"abc"), (b"a\xc3\x28", b"a\xe0"), (b"", b"x"), (b"\x00z", b"\x02"))] == [b"abd", b"a\xfe1", b"ab", b"a\xc4", b"", b"\x01"]
    successor = lambda a: bytes(value(scalars.short_successor(F.lit(bytearray(a)))))
    assert [successor(a) for a in (b"abc", b"\xff\xff", b"\xffab", b"", b"\xfe")] == [b"b", b"\xff\xff", b"\xffb", b"", b"\xff"]
    for x in (0, 1, 127, 1 << 7, 1 << 14, 1 << 21, 1 << 28, 1 << 35, 1 << 42, 1 << 49, 1 << 58, (1 << 63) - 1):
        coded = bytes(value(scalars.varint_encode(n(x))))
        plain = [x >> 7 * i & 127 for i in range(max(1, -(-x.bit_length() // 7)))][::-1]
        assert coded == bytes([*(b | 128 for b in plain[:-1]), plain[-1]]) and value(scalars.varint_decode(F.lit(bytearray(coded)))) == x
    assert value(hashes.bkdr(F.lit(""))) == 0


def test_bloom(spark):
    strings = spark.createDataFrame([("",), ("a",), ("b",), ("aaaaa",), ("cc",)], "s string")
    bits = bloom.build(strings, 1024)
    asked = spark.createDataFrame([("",), ("a",), ("b",), ("aaaaa",), ("cc",), ("dd",), ("ab",)], "s string")
    assert {r["s"] for r in bloom.test(asked, bits, 1024).where("present").collect()} == {"", "a", "b", "aaaaa", "cc"}


TIED = [("a", 3, 0, "x", 1), ("a", 3, 1, "y", 0), ("a", 2, 0, "z", 2), ("b", 1, 0, "p", 1), ("b", 1, 0, "q", 0)]


def test_ties_take_one_whole_record_as_a_merge_does(spark):
    runs = spark.createDataFrame(TIED, LOG + ", run int")
    by_run = [runs.where(F.col("run") == i).drop("run") for i in range(3)]
    first = {}
    for r in merge.merge(spark, by_run).orderBy("rank").collect():
        first.setdefault(r["k"], (r["k"], r["v"], r["flag"], r["val"]))
    assert {r["k"]: tuple(r) for r in visible.newest(runs).collect()} == first == {"a": ("a", 3, 1, "y"), "b": ("b", 1, 0, "q")}
    assert {tuple(r) for r in visible.newest(runs.drop("run")).collect()} <= {t[:4] for t in TIED}
    assert [tuple(r) for r in merge.merged_visible(spark, by_run).collect()] == [("b", 1, "q", 1)]


def test_an_iterator_over_runs_hides_what_a_newer_run_deletes(spark):
    runs = [log(spark, [("a", 1, 0, "1"), ("c", 2, 0, "2")]), log(spark, [("a", 3, 1, ""), ("b", 4, 0, "4")]), log(spark, [("c", 5, 0, "5")])]
    assert [(r["k"], r["val"]) for r in merge.merged_visible(spark, runs).orderBy("rank").collect()] == [("b", "4"), ("c", "5")]
    assert [(r["k"], r["val"]) for r in merge.merged_visible(spark, runs, 2).orderBy("rank").collect()] == [("a", "1"), ("c", "2")]
    assert merge.merged_visible(spark, []).count() == 0


def test_hot_keys_give_the_same_rows(spark):
    rows = log(spark, [("hot", i, int(i % 50 == 49), str(i)) for i in range(400)] + [(f"k{i}", 400 + i, 0, "") for i in range(30)])
    for f in (lambda n: compaction.collect_garbage(rows, 200, hot_rows=n), lambda n: compaction.merge_inputs(rows, hot_rows=n)):
        few, many = ({tuple(r) for r in f(n).collect()} for n in (30, ordered.HOT_ROWS))
        assert few == many and len(few) >= 30
    plan = compaction.collect_garbage(rows, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_neighbours_and_previous_values_over_partitions(spark):
    rows = spark.range(500).select(F.lpad((F.col("id") * 7919 % 500).cast("string"), 3, "0").alias("k")).repartition(9)
    got = {r["k"]: (r["prev_k"], r["next_k"]) for r in cursor.walk(rows).collect()}
    assert got == {f"{i:03}": (f"{i - 1:03}" if i else None, f"{i + 1:03}" if i < 499 else None) for i in range(500)}
    versions = log(spark, [(f"k{i % 3}", i, 0, str(i)) for i in range(90)]).repartition(7)
    assert {r["v"]: r["previous"] for r in visible.previous_values(versions).collect()} == {i: str(i - 3) if i >= 3 else None for i in range(90)}


def test_upserts(spark):
    done = visible.upserts(log(spark, HISTORY), log(spark, [("aaa", 2, 0, "x"), ("aaa", 9, 0, "y")]))
    assert {(r["v"], r["already_existed"], r["old_value"]) for r in done.collect()} == {(2, True, "2"), (9, False, None)}


def test_replay_stops_at_the_first_bad_checksum(spark):
    records = spark.createDataFrame([(i, f"r{i}") for i in range(10)], "pos long, payload string").withColumn("crc", recovery.checksum())
    torn = records.withColumn("payload", F.when(F.col("pos") == 6, "rx").otherwise(F.col("payload")))
    assert [(r["payload"], r["v"]) for r in recovery.replay(torn, 40).orderBy("pos").collect()] == [(f"r{i}", 41 + i) for i in range(6)]
    assert recovery.replay(records, 0).count() == 10


def test_stream_replays_to_the_newest(spark):
    from kvlake.plans import catalog
    from kvlake.sources.tables import event_log
    from tests.oracle import SF

    want = {tuple(r) for r in visible.newest(event_log(spark, SF)).collect()}
    assert {tuple(r) for r in catalog.QUERIES["stream_latest"](spark, SF).collect()} == want
