"""A partitioned, append-only log with offsets, segments, retention, consumer groups and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1a32

DEFAULT_READ, DEFAULT_SEGMENT = 1000, 100


class OffsetOutOfRange(ValueError):
    """An offset below the log's start or beyond its head."""


def partition_for(key: Column, partitions: int, arrival: Column) -> Column:
    """FNV-1a of the key modulo the partitions; rows with a null or empty key take turns by their arrival number."""
    turn = F.pmod(arrival, F.lit(partitions))
    return F.when(F.coalesce(key, F.lit("")) == "", turn).otherwise(F.pmod(fnv1a32(key), F.lit(partitions))).cast("int")


def append(records: DataFrame, partition: str, order: list[str], heads: DataFrame | None = None, segment: int = DEFAULT_SEGMENT) -> DataFrame:
    """`records` with offset and segment_id, in `order` within a partition.

    heads (partition, next_offset) are the heads to go on from; without them offsets begin at 0. Offsets are never
    given twice. A segment is named by the offset of its first record.
    """
    local = F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1
    numbered = records.withColumn("__local", local.cast("long"))
    if heads is not None:
        numbered = numbered.join(heads.select(partition, F.col("next_offset").alias("__head")), partition, "left")
    else:
        numbered = numbered.withColumn("__head", F.lit(0).cast("long"))
    offset = F.col("__local") + F.coalesce("__head", F.lit(0))
    return numbered.withColumn("offset", offset).withColumn("segment_id", F.floor(F.col("offset") / segment) * segment).drop("__local", "__head")


def watermarks(log: DataFrame, partition: str) -> DataFrame:
    """(partition, log_start, high_watermark) of partitions that hold records."""
    return log.groupBy(partition).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("high_watermark"))


def read(log: DataFrame, partition: str, number: int, start: int, most: int = DEFAULT_READ, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Up to `most` records of a partition from `start` on (`most` <= 0: 1000), by offset.

    At the head the result is empty; below the log's start or beyond the head it is an error. bounds (start, head)
    stand in where the log keeps them apart, as it has to for a partition that retention emptied.
    """
    own = log.where(F.col(partition) == number)
    if bounds is None:
        got = own.agg(F.min("offset"), F.max("offset") + 1).first()
        bounds = (got[0] or 0, got[1] or 0)
    if not bounds[0] <= start <= bounds[1]:
        raise OffsetOutOfRange(f"{start} is outside {bounds[0]} to {bounds[1]}")
    most = most if most > 0 else DEFAULT_READ
    return own.where((F.col("offset") >= start) & (F.col("offset") < start + most)).orderBy("offset")


def truncate_before(log: DataFrame, partition: str, cut: Column | int) -> DataFrame:
    """`log` without the segments whose last offset is below the cut; the others stay whole."""
    last = log.groupBy(partition, "segment_id").agg(F.max("offset").alias("last"))
    gone = last.where(F.col("last") < (F.lit(cut) if isinstance(cut, int) else cut)).select(partition, "segment_id")
    return log.join(gone, [partition, "segment_id"], "left_anti")


def assignment(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """(partition, member): partition i goes to member i mod m, members in order of joining (`joined`)."""
    turns = members.select("member", (F.row_number().over(Window.orderBy("joined")) - 1).alias("turn"))
    count = members.agg(F.count(F.lit(1)).alias("m"))
    dealt = partitions.crossJoin(F.broadcast(count)).where("m > 0").withColumn("turn", F.pmod(F.col("partition"), F.col("m")).cast("int"))
    return dealt.join(F.broadcast(turns), "turn").select("partition", "member")


def poll(log: DataFrame, partition: str, offsets: DataFrame, most: int = DEFAULT_READ) -> DataFrame:
    """Up to `most` records of each partition from its committed offset on, ordered by (offset, partition).

    offsets: (partition, next_offset); a partition without one starts at 0. Where retention has passed the committed
    offset the poll gives nothing of that partition: `resets` says where to go on.
    """
    starts = watermarks(log, partition).join(offsets, partition, "left").select(partition, F.coalesce("next_offset", F.lit(0)).alias("__from"), "log_start")
    fit = starts.where(F.col("__from") >= F.col("log_start"))
    got = log.join(fit, partition).where((F.col("offset") >= F.col("__from")) & (F.col("offset") < F.col("__from") + most))
    return got.drop("__from", "log_start").orderBy("offset", partition)


def resets(log: DataFrame, partition: str, offsets: DataFrame) -> DataFrame:
    """(partition, next_offset): partitions whose committed offset retention has passed, at the log's start."""
    return watermarks(log, partition).join(offsets, partition).where(F.col("next_offset") < F.col("log_start")).select(partition, F.col("log_start").alias("next_offset"))


def commit(offsets: DataFrame, polled: DataFrame, partition: str) -> DataFrame:
    """(partition, next_offset) after `polled` was processed. Offsets belong to partitions and outlive their members."""
    moved = polled.groupBy(partition).agg((F.max("offset") + 1).alias("next_offset"))
    return offsets.select(partition, "next_offset").unionByName(moved).groupBy(partition).agg(F.max("next_offset").alias("next_offset"))


def group_lag(log: DataFrame, partition: str, offsets: DataFrame) -> DataFrame:
    """(partition, next_offset, high_watermark, lag)."""
    met = watermarks(log, partition).join(offsets, partition, "left")
    at = F.coalesce("next_offset", F.lit(0))
    return met.select(partition, at.alias("next_offset"), "high_watermark", (F.col("high_watermark") - at).alias("lag"))
