import pytest
from pyspark.sql import functions as F

from millrace.operators import log as L


def make(spark, n, segment=4, partitions=1):
    rows = spark.range(n).select((F.col("id") % partitions).cast("int").alias("p"), F.col("id").alias("i"))
    return L.append(rows, "p", ["i"], segment=segment)


def test_offsets_and_reads(spark):
    log = make(spark, 10)
    assert [r.offset for r in L.read(log, "p", 0, 3, 4).collect()] == [3, 4, 5, 6]
    assert L.read(log, "p", 0, 10).count() == 0 and L.read(log, "p", 0, 0, 0).count() == 10
    for bad in (-1, 11):
        with pytest.raises(L.OffsetOutOfRange):
            L.read(log, "p", 0, bad)


def test_retention_drops_whole_segments_and_offsets_go_on(spark):
    log = make(spark, 12, 3)
    kept = L.truncate_before(log, "p", 7)
    marks = L.watermarks(kept, "p").first()
    assert (marks.log_start, marks.high_watermark) == (6, 12)
    with pytest.raises(L.OffsetOutOfRange):
        L.read(kept, "p", 0, 5)
    none = L.truncate_before(log, "p", 100)
    assert none.count() == 0 and L.read(none, "p", 0, 12, bounds=(12, 12)).count() == 0
    heads = spark.createDataFrame([(0, 12)], "p int, next_offset long")
    assert [r.offset for r in L.append(spark.range(2).select(F.lit(0).alias("p"), F.col("id").alias("i")), "p", ["i"], heads).orderBy("offset").collect()] == [12, 13]


def test_keys_stick_and_rows_without_one_take_turns(spark):
    rows = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "k").alias("key"))
    got = rows.withColumn("p", L.partition_for(F.col("key"), 4, F.col("id"))).collect()
    assert len({r.p for r in got if r.key == "k"}) == 1
    assert all(r.p == r.id % 4 for r in got if not r.key)


def test_rebalancing_keeps_offsets(spark):
    parts = spark.range(6).select(F.col("id").cast("int").alias("partition"))
    for m, want in ((1, [6]), (2, [3, 3]), (3, [2, 2, 2])):
        members = spark.range(m).select(F.concat(F.lit("m"), "id").alias("member"), F.col("id").alias("joined"))
        assert sorted(r["count"] for r in L.assignment(parts, members).groupBy("member").count().collect()) == want
    log = make(spark, 12, 3, 2).withColumnRenamed("p", "partition")
    offsets = spark.createDataFrame([(0, 2)], "partition int, next_offset long")
    polled = L.poll(log, "partition", offsets, 3)
    assert [(r.partition, r.offset) for r in polled.collect()] == [(1, 0), (1, 1), (0, 2), (1, 2), (0, 3), (0, 4)]
    assert {tuple(r) for r in L.commit(offsets, polled, "partition").collect()} == {(0, 5), (1, 3)}
    kept = L.truncate_before(log, "partition", 3)
    assert {r.partition for r in L.poll(kept, "partition", offsets).collect()} == set()
    assert {tuple(r) for r in L.resets(kept, "partition", offsets).collect()} == {(0, 3)}
