from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit as A
from millrace.operators import causal as K

PAIRS = [({"a": 1}, {"a": 1}, "equal"), ({"a": 1}, {"a": 2}, "before"), ({"a": 2}, {"a": 1}, "after"), ({"a": 1}, {"b": 1}, "concurrent"), ({}, {"a": 1}, "before"), ({"a": 0}, {}, "equal"), ({"a": 2, "b": 1}, {"a": 1, "b": 2}, "concurrent")]


def test_clock_pairs(spark):
    frame = spark.createDataFrame(PAIRS, "a map<string,bigint>, b map<string,bigint>, want string")
    for r in frame.withColumn("got", K.compare(F.col("a"), F.col("b"))).withColumn("m", K.merge(F.col("a"), F.col("b"))).collect():
        assert r.got == r.want
        assert r.m == {k: max(r.a.get(k, 0), r.b.get(k, 0)) for k in {*r.a, *r.b}}
    row = frame.limit(1).select(K.format_clock(K.bump(K.bump(F.col("a"), "b"), "a")).alias("x")).first()
    assert row.x == "{a:2,b:1}"


REPLICAS = "node string, key string, value string, deleted boolean, clock map<string,bigint>, i long"


def test_siblings_and_anti_entropy(spark):
    rows = [("n1", "k", "apple", False, {"n1": 1}, 1), ("n2", "k", "banana", False, {"n2": 1}, 2), ("n1", "s", "stale", False, {"n1": 1}, 3), ("n2", "s", "fresh", False, {"n1": 2}, 4), ("n1", "t", "x", False, {"n1": 1}, 5), ("n2", "t", None, True, {"n1": 2}, 6)]
    frame = spark.createDataFrame(rows, REPLICAS)
    found = K.siblings(frame, "key", "i")
    assert {(r.key, r.value) for r in found.collect()} == {("k", "apple"), ("k", "banana"), ("s", "fresh"), ("t", None)}
    assert {(r.key, r.value) for r in K.visible_values(found).collect()} == {("k", "apple"), ("k", "banana"), ("s", "fresh")}
    assert K.anti_entropy(frame, "key", "i").where("key = 's' and value = 'fresh'").count() == 2
    same = spark.createDataFrame([("n1", "k", "one", False, {"n1": 1}, 1), ("n2", "k", "two", False, {"n1": 1}, 2)], REPLICAS)
    assert [r.value for r in K.siblings(same, "key", "i").collect()] == ["two"]


def test_quorum_reads_and_hints(spark):
    rows = [("n0", "k", "old", False, {"n0": 1}, 1), ("n1", "k", "new", False, {"n0": 2}, 2), ("n2", "k", "old", False, {"n0": 1}, 3)]
    frame = spark.createDataFrame(rows, REPLICAS)
    prefs = spark.createDataFrame([("k", f"n{i}", i) for i in range(3)], "key string, node string, place int")
    live = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    assert [r.value for r in K.quorum_read(frame, prefs, live("n0", "n1", "n2"), 2, "key", "i").collect()] == ["new"]
    assert [r.value for r in K.quorum_read(frame, prefs, live("n0", "n2"), 2, "key", "i").collect()] == ["old"]
    assert K.quorum_read(frame, prefs, live("n0"), 2, "key", "i").count() == 0
    hints = frame.where("node = 'n1'").withColumn("dest", F.lit("n2"))
    assert [r.value for r in K.deliver_hints(frame, hints, "n2", "key", "i").collect()] == ["new"]
    assert K.quorum_overlap(3, 2, 2) and not K.quorum_overlap(3, 1, 2)
    assert spark.range(1).select(K.preference_list(F.lit(4), 5, 3).alias("p")).first().p == [4, 0, 1]


def test_lamport_and_vectors_follow_messages(spark):
    rows = [(1, 1, "a", "local", None), (1, 2, "a", "send", "m"), (1, 3, "b", "local", None), (1, 4, "b", "recv", "m"), (1, 5, "a", "local", None)]
    got = [(r.lamport, r.vector) for r in K.lamport(spark.createDataFrame(rows, "run long, i long, node string, kind string, message string"), "i").orderBy("i").collect()]
    assert got == [(1, "{a:1}"), (2, "{a:2}"), (1, "{b:1}"), (3, "{a:2,b:2}"), (3, "{a:3}")]


def test_hybrid_clocks(spark):
    rows = spark.createDataFrame([(7, i, w) for i, w in enumerate([1000, 1000, 900, 900, 3000, 2000])], "node int, seq int, wall_ms long")
    got = [(r.physical, r.logical) for r in K.hlc_now(rows, "node", ["seq"]).orderBy("seq").collect()]
    assert got == [(1000, 0), (1000, 1), (1000, 2), (1000, 3), (3000, 0), (3000, 1)] and got == sorted(got)
    update = lambda *v: tuple(spark.range(1).select(K.hlc_update(*[F.lit(x).cast("long") for x in v]).alias("c")).first().c)
    assert update(10, 2, 10, 5, 9) == (10, 6) and update(10, 2, 9, 5, 8) == (10, 3) and update(1, 9, 20, 4, 20) == (20, 5) and update(1, 9, 2, 4, 30) == (30, 0)
    row = spark.range(1).select(K.skew_rejected(F.lit(5000), F.lit(0), 500).alias("a"), K.skew_rejected(F.lit(100), F.lit(0), 500).alias("b"), K.wall_time(F.lit(1767225600000)).cast("timestamp_ntz").alias("t")).first()
    assert row.a and not row.b and row.t == datetime(2026, 1, 1)


def test_sortable_ids(spark):
    rows = spark.range(12000).select(F.lit(7).cast("long").alias("node"), "id", (F.lit(1_767_225_600_000) + F.floor(F.col("id") / 6000)).alias("ms"))
    got = K.assign_ids(rows, "node", "ms", ["id"], "sid").orderBy("id").collect()
    ids = [r.sid for r in got]
    assert ids == sorted(set(ids))  # unique, rising, although 6000 share a millisecond
    parts = K.assign_ids(rows.limit(1), "node", "ms", ["id"], "sid").select(*[c.alias(f"c{i}") for i, c in enumerate(K.decode_id(F.col("sid")))]).first()
    assert tuple(parts) == (1_767_225_600_000, 7, 0)


def test_replication_histories(spark):
    log = [(n, i, 1, f"k{i}", "v", i <= 3) for n in ("n1", "n2", "n3") for i in (1, 2, 3)] + [("n4", 0, 0, "k0", "v", True), ("n5", 0, 0, "k0", "v", True)] + [(n, 0, 0, "k0", "v", True) for n in ("n1", "n2", "n3")]
    frame = spark.createDataFrame(log, "node string, idx long, term long, key string, value string, committed boolean")
    dead = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string")
    assert sorted(r.idx for r in A.failover_loss(frame, dead).collect()) == [1, 2, 3]
    marks = spark.createDataFrame([(f"n{i}", x) for i, x in enumerate([9, 7, 5, 3, 1])], "node string, idx long")
    commit = A.quorum_commit(marks)
    assert commit.first().commit_idx == 5
    terms = spark.createDataFrame([(5, 2)], "idx long, term long")
    assert A.own_term_commit(commit, terms, 2).first().commit_idx == 5 and A.own_term_commit(commit, terms, 3).first().commit_idx == 0
    row = spark.range(1).select(A.up_to_date(F.lit(2), F.lit(1), F.lit(1), F.lit(9)).alias("a"), A.up_to_date(F.lit(1), F.lit(8), F.lit(1), F.lit(9)).alias("b")).first()
    assert row.a and not row.b
    assert [A.needed_acks(m, 5) for m in ("async", "quorum", "all")] == [1, 3, 5]


def test_commits_across_participants(spark):
    parts = spark.createDataFrame([(t, p) for t in ("yes", "no", "silent") for p in "abc"], "txn string, participant string")
    votes = spark.createDataFrame([("yes", p, "commit") for p in "abc"] + [("no", "a", "commit"), ("no", "b", "abort"), ("no", "c", "commit"), ("silent", "a", "commit")], "txn string, participant string, vote string")
    assert {r.txn: r.decision for r in A.decide(parts, votes).collect()} == {"yes": "commit", "no": "abort", "silent": "abort"}
    log = spark.createDataFrame([("t", p, "prepare") for p in "abc"] + [("u", "a", "prepare"), ("u", "a", "commit")], "txn string, participant string, action string")
    assert A.in_doubt(log).count() == 3


@pytest.mark.parametrize("oks, want", [([True, True, False, True], ["do debit", "do credit", "fail notify", "undo credit", "undo debit"]), ([True, True, True, True], ["do debit", "do credit", "do notify", "do end"])])
def test_sagas(spark, oks, want):
    steps = spark.createDataFrame([("s", i, n, ok) for i, (n, ok) in enumerate(zip(["debit", "credit", "notify", "end"], oks), 1)], "saga string, step long, name string, ok boolean")
    assert [f"{r.action} {r.name}" for r in A.run_sagas(steps).orderBy("n").collect()] == want
