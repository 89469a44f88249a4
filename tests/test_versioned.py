import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import versioned as V

WRITES = "seq long, key string, value string, is_delete boolean"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.sampled_from("xyz"))), max_size=40))
def test_last_write_wins_like_a_dictionary(spark, ops):
    model = {}
    for k, v in ops:
        model.update({k: v}) if v is not None else model.pop(k, None)
    frame = spark.createDataFrame([(i, k, v, v is None) for i, (k, v) in enumerate(ops)], WRITES)
    assert {r.key: r.value for r in V.live(frame, "key", ["seq"]).collect()} == model
    top = V.compact(frame, "key", ["seq"], last_level=False)
    assert {r.key for r in top.collect()} == {k for k, _ in ops}
    assert {r.key: r.value for r in V.live(top, "key", ["seq"]).collect()} == model


def test_reads_and_scans(spark):
    frame = spark.range(3000).select(F.col("id").alias("seq"), F.format_string("key-%04d", F.col("id") % 500).alias("key"), F.col("id").cast("string").alias("value"), (F.col("id") % 7 == 0).alias("is_delete"))
    live = V.live(frame, "key", ["seq"])
    assert live.count() == 500 - sum((2500 + k) % 7 == 0 for k in range(500))
    got = [r.key for r in V.seek(live, "key", "key-0250", 3).collect()]
    assert got == sorted(got) and got[0] >= "key-0250"
    assert V.get(frame, "key", ["seq"], "key-0001").first().value == "2501"
    assert V.get(frame, "key", ["seq"], "none").count() == 0
    assert V.by_ranges(live, "key", 3).rdd.getNumPartitions() == 3


def test_sources_shadow_each_other(spark):
    new, old = (spark.createDataFrame(rows, "key string, v long") for rows in ([("a", 2)], [("a", 1), ("b", 1)]))
    assert {tuple(r) for r in V.merge_sources([new, old], "key").collect()} == {("a", 2), ("b", 1)}


def test_checksums(spark):
    good = spark.createDataFrame([(1, bytearray(b"abc"))], "i long, payload binary").withColumn("crc", F.crc32("payload"))
    assert V.checked_records(good, "payload", "crc").count() == 1
    bad = good.withColumn("crc", F.col("crc") + 1)
    assert V.checked_records(bad, "payload", "crc", F.lit(True)).count() == 0
    with pytest.raises(Exception, match="checksum"):
        V.checked_records(bad, "payload", "crc").count()


def test_snapshots_and_garbage(spark):
    rows = spark.createDataFrame([("k", f"v{i}", i, False) for i in range(1, 7)] + [("d", "x", 2, False), ("d", None, 4, True)], "key string, value string, start_ts long, deleted boolean")
    history = V.versions(rows, "key", [])
    at = lambda ts: {r.key: r.value for r in V.snapshot(history, ts).collect()}
    assert at(0) == {} and at(3) == {"k": "v3", "d": "x"} and at(9) == {"k": "v6"}
    assert V.collect_garbage(history, 1).count() == 8
    assert {(r.key, r.start_ts) for r in V.collect_garbage(history, 100).collect()} == {("k", 6), ("d", 4)}


TXNS = "db string, txn long, iso string, read_ts long, commit_ts long, reads array<string>, writes array<string>"


@pytest.mark.parametrize("iso, second", [("snapshot", True), ("serializable", False)])
def test_write_skew_is_let_through_or_refused(spark, iso, second):
    rows = [("d", 1, iso, 0, 10, ["alice", "bob"], ["alice"]), ("d", 2, iso, 0, 11, ["alice", "bob"], ["bob"])]
    got = {r.txn: (r.committed, r.reason) for r in V.replay_commits(spark.createDataFrame(rows, TXNS), "db").collect()}
    assert got[1] == (True, None) and got[2] == ((True, None) if second else (False, "read alice"))
    frame = spark.createDataFrame(rows, TXNS)
    reads, writes = (frame.select("txn", F.explode(c).alias("key")) for c in ("reads", "writes"))
    assert [tuple(r) for r in V.write_skew(frame, reads, writes).collect()] == [(1, 2)]


def test_lost_updates_are_refused(spark):
    rows = [("d", 1, "snapshot", 0, 10, ["n"], ["n"]), ("d", 2, "snapshot", 0, 11, ["n"], ["n"]), ("d", 3, "snapshot", 10, 12, ["n"], ["n"])]
    got = {r.txn: r.reason for r in V.replay_commits(spark.createDataFrame(rows, TXNS), "db").collect()}
    assert got == {1: None, 2: "write n", 3: None}
