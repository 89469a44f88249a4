"""Windows on a stream with Spark's own semantics, and an idempotent keyed sink.

Spark closes a window when the watermark reaches its end and judges lateness by the watermark of the batch before; the
exact batch form in `millrace.operators.windowing` closes it when the watermark is past the end and judges each event
at once. Use that form where the difference counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.windowing import YEAR_ONE


def window_stream(events: DataFrame, time_col: str, key_col: str, value: Column, size_s: int, delay_s: int, slide_s: int | None = None) -> DataFrame:
    """(window_start, window_end, key, total, n) of a stream; state is dropped `delay_s` after a window's end."""
    timed = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", f"{delay_s} seconds")
    slide = slide_s or size_s
    if slide > size_s:
        raise ValueError("a slide over the size leaves gaps, which Spark's windows don't")
    start = f"{(-YEAR_ONE) % slide} seconds"
    window = F.window("__t", f"{size_s} seconds", f"{slide} seconds", start)
    out = timed.groupBy(window.alias("w"), F.col(key_col).alias("key")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "key", "total", "n")


class KeyedSink:
    """A table of one row per key, written by streams or batches; writing a batch again changes nothing.

    Each write reads the current version, lays the new rows over it, writes a new version folder, and then moves the
    pointer, a one-line table, in one rename. The number of the last batch is part of the version. A version holds all
    keys, so a batch costs as much as the table: this is for aggregates, which are small beside what they sum up.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.at = hadoop.Path

    def state(self) -> dict:
        """The version in use: folder, last batch, attempts (rows ever written), logical (keys held)."""
        file = self.at(f"{self.path}/CURRENT")
        if not self.fs.exists(file):
            return {"folder": None, "batch": -1, "attempts": 0, "logical": 0}
        stream = self.fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        folder = self.state()["folder"]
        return self.spark.read.parquet(folder) if folder else None

    def upsert(self, rows: DataFrame, batch: int) -> None:
        state = self.state()
        if batch <= state["batch"]:
            return
        rows, held = rows.persist(), self.read()
        try:
            incoming = rows.count()
            kept = held.join(rows.select(*self.keys).distinct(), self.keys, "left_anti") if held is not None else None
            folder = f"{self.path}/v{batch}-{uuid.uuid4().hex[:8]}"
            merged = kept.unionByName(rows) if kept is not None else rows
            merged.write.parquet(folder)
            self.point({"folder": folder, "batch": batch, "attempts": state["attempts"] + incoming, "logical": self.spark.read.parquet(folder).count()})
        finally:
            rows.unpersist()

    def point(self, state: dict) -> None:
        new, current = self.at(f"{self.path}/.CURRENT-{uuid.uuid4().hex}"), self.at(f"{self.path}/CURRENT")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, current, options)


def run_to_end(stream: DataFrame, sink: KeyedSink, checkpoint: str, mode: str = "update", also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Feeds all that a source has into a keyed sink and stops; called again it goes on where it stopped."""

    def write(batch: DataFrame, number: int) -> None:
        sink.upsert(batch, number)
        if also:
            also(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query
