from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import windowing as W
from millrace.streaming.native import KeyedSink, run_to_end, window_stream

BASE = datetime(2026, 1, 1, 12)
SCHEMA = "key string, value long, ts timestamp_ntz"


def write(spark, path, rows):
    spark.createDataFrame([(k, v, BASE + timedelta(seconds=s)) for k, v, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_restart_and_batch_agree(spark, tmp_path):
    source, sink = f"{tmp_path}/in", KeyedSink(spark, f"{tmp_path}/sink", ["window_start", "window_end", "key"])
    write(spark, source, [("a", 1, 1), ("b", 2, 2), ("a", 3, 13)])
    stream = lambda: window_stream(spark.readStream.schema(SCHEMA).parquet(source), "ts", "key", F.col("value"), 10, 5)
    run_to_end(stream(), sink, f"{tmp_path}/checkpoint")
    first = sink.state()
    run_to_end(stream(), sink, f"{tmp_path}/checkpoint")  # nothing new
    assert sink.read().count() == 3 and sink.state()["logical"] == first["logical"] == 3
    write(spark, source, [("a", 10, 14), ("c", 5, 15)])
    run_to_end(stream(), sink, f"{tmp_path}/checkpoint")
    got = {(r.window_start, r.key, r.total, r.n) for r in sink.read().collect()}
    batch = W.window_sums(spark.read.parquet(source), "ts", "key", F.col("value"), 10)
    assert got == {(r.window_start, r.key, r.total, r.n) for r in batch.collect()}


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    sink = KeyedSink(spark, f"{tmp_path}/sink", ["k"])
    assert sink.read() is None
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    sink.upsert(rows, 0)
    before = sink.state()
    sink.upsert(rows, 0)
    assert sink.state() == before
    sink.upsert(spark.createDataFrame([("y", 3)], "k string, v long"), 1)
    assert {tuple(r) for r in sink.read().collect()} == {("x", 1), ("y", 3)}
    assert sink.state()["attempts"] == 3 and sink.state()["logical"] == 2


def test_gaps_are_refused(spark):
    with pytest.raises(ValueError):
        window_stream(spark.createDataFrame([], SCHEMA), "ts", "key", F.col("value"), 10, 0, 20)
