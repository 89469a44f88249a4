import pytest
from pyspark.sql import functions as F

from millrace.operators import cdc as C
from millrace.operators import events as E

CHANGES = "lsn long, tbl string, op string, pk string, before string, after string"
EVENTS = "stream string, version long, global_pos long, type string, amount long"


def people(spark, n=60):
    rows = [(i, "people", "insert", f"p{i}", None, f"v{i}") for i in range(1, n + 1)]
    rows += [(n + 1, "people", "update", "p1", "v1", "new"), (n + 2, "people", "delete", "p2", "v2", None)]
    return spark.createDataFrame(rows, CHANGES)


def test_images(spark):
    writes = spark.createDataFrame([(1, "a", "x", False), (2, "a", "y", False), (3, "b", None, True), (4, "a", None, True), (5, "a", "z", False)], "seq long, key string, value string, is_delete boolean")
    got = [(r.op, r.pk, r.before, r.after) for r in C.change_log(writes, "key", "value", ["seq"]).orderBy("seq").collect()]
    assert got == [("insert", "a", None, "x"), ("update", "a", "x", "y"), ("delete", "a", "y", None), ("insert", "a", None, "z")]


def test_apply_is_idempotent_and_takes_any_order(spark):
    log = people(spark)
    once = {tuple(r) for r in C.apply_changes(log).collect()}
    assert len(once) == 59 and ("p1", "new", 61) in once
    assert {tuple(r) for r in C.apply_changes(log.union(log).union(log).orderBy(F.desc("lsn"))).collect()} == once


@pytest.mark.parametrize("cut", [0, 50, 61, 99])
def test_bootstrap_and_tail_converge(spark, cut):
    log = people(spark)
    assert C.reconcile(C.apply_changes(log), C.bootstrap_and_tail(log, cut)).isEmpty()


def test_differences_and_cursor(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "pk string, value long")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "4")], "pk string, value string")
    assert {(r.pk, r.kind) for r in C.reconcile(a, b).collect()} == {("x", "missing"), ("y", "unequal"), ("w", "extra")}
    log = people(spark)
    assert C.cursor(C.changes_since(log, 60), 60) == 62 and C.cursor(C.changes_since(log, 62), 62) == 62


def test_schema_versions(spark):
    ddl = spark.createDataFrame([("people", 1, i, "create", n, "string", None) for i, n in enumerate(("pk", "name", "city"))] + [("people", 2, 0, "add", "email", "string", "none"), ("people", 3, 0, "drop", "city", None, None)], "tbl string, seq int, ordinal int, action string, name string, type string, default string")
    versions = {r.version: [tuple(c) for c in r.columns] for r in C.schema_versions(ddl).collect()}
    assert [[c[0] for c in versions[v]] for v in (1, 2, 3)] == [["pk", "name", "city"], ["pk", "name", "city", "email"], ["pk", "name", "email"]]
    rows = spark.createDataFrame([("1", {"name": "a", "city": "c"}), ("2", {"name": "b", "email": "e"})], "pk string, fields map<string,string>")
    assert {tuple(r) for r in C.read_at_version(rows, versions[3]).collect()} == {("1", "a", "none"), ("2", "b", "e")}
    assert C.read_at_version(rows, versions[1]).columns == ["pk", "name", "city"]


def test_patches(spark):
    row = spark.range(1).select(F.create_map(F.lit("pk"), F.lit("1"), F.lit("n"), F.lit("a")).alias("b"))
    patched = row.select(C.patch(F.col("b"), F.create_map(F.lit("n"), F.lit("z"))).alias("m")).first().m
    assert patched == {"pk": "1", "n": "z"}
    same, other = (F.create_map(F.lit("pk"), F.lit(v)) for v in ("1", "2"))
    assert row.select(C.reject_rekeying(same, F.col("b"), "pk").alias("m")).first().m == {"pk": "1"}
    with pytest.raises(Exception, match="primary key"):
        row.select(C.reject_rekeying(other, F.col("b"), "pk").alias("m")).collect()


def events(spark, *rows):
    return spark.createDataFrame([(s, v, p, t, a) for p, (s, v, t, a) in enumerate(rows, 1)], EVENTS)


def test_replay_and_projection_differ_where_they_should(spark):
    log = events(spark, ("a", 1, "Opened", 0), ("a", 2, "Deposited", 100), ("a", 3, "Withdrawn", 40), ("a", 4, "Opened", 0), ("b", 1, "Deposited", 5), ("b", 2, "Closed", 0), ("c", 1, "Closed", 0), ("c", 2, "Deposited", 7))
    assert {tuple(r) for r in E.replay(log).collect()} == {("a", 60, 4, False), ("b", 5, 2, True), ("c", 7, 2, True)}
    assert {tuple(r) for r in E.project(log).collect()} == {("a", 0), ("c", 7)}


def test_projection_catches_up(spark):
    first = events(spark, ("a", 1, "Opened", 0), ("a", 2, "Deposited", 50), ("a", 3, "Withdrawn", 20), ("b", 1, "Opened", 0), ("b", 2, "Deposited", 50))
    more = first.union(spark.createDataFrame([("b", 3, 6, "Deposited", 10)], EVENTS))
    assert {tuple(r) for r in E.catch_up(E.project(first), more, 5).collect()} == {("a", 30), ("b", 60)}


def test_snapshot_and_full_replay_agree(spark):
    log = events(spark, ("a", 1, "Opened", 0), *[("a", i, "Deposited", 10) for i in range(2, 12)], ("a", 12, "Deposited", 5))
    assert E.snapshot_and_tail(E.replay(log.where("version <= 11")), log).first() == E.replay(log).first()
    assert E.replay(log).first().balance == 105


def test_rules_conflicts_and_numbers(spark):
    log = events(spark, ("a", 1, "Opened", 0), ("a", 2, "Deposited", 100), ("a", 3, "Withdrawn", 80), ("a", 4, "Withdrawn", 80), ("a", 5, "Closed", 0), ("a", 6, "Deposited", 1))
    assert [r.allowed for r in E.judge_commands(log).orderBy("version").collect()] == [True, True, True, False, False, False]
    tries = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 1, 3)], "stream string, expected long, i long")
    assert [r.conflict for r in E.audit_appends(tries, ["i"]).orderBy("i").collect()] == [False, False, True]
    row = spark.range(1).select(E.lenient_int(F.lit(-2.7), "double").alias("a"), E.lenient_int(F.lit("5"), "string").alias("b"), E.lenient_int(F.lit(7), "int").alias("c"), E.describe(F.lit("s"), F.lit(2), F.lit("T"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("d")).first()
    assert tuple(row) == (-2, 0, 7, "s@2 T{a=2 b=1}")
