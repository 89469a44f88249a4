"""Event sourcing: appends with expected versions, replay, projections, snapshots, rules over running balances.

Events: stream, version, global_pos, type (Opened, Deposited, Withdrawn, Closed), amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta() -> Column:
    """What an event adds to the balance."""
    return F.when(F.col("type") == "Deposited", F.col("amount")).when(F.col("type") == "Withdrawn", -F.col("amount")).otherwise(0)


def lenient_int(value: Column, kind: str) -> Column:
    """Whole numbers as they are, fractions cut toward 0, anything else 0."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(value.cast("bigint"), F.lit(0))
    if kind in ("float", "double"):
        cut = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
        return F.coalesce(F.when(F.isnan(value), 0).otherwise(cut.try_cast("bigint")), F.lit(0))
    return F.lit(0).cast("bigint")


def load_from(events: DataFrame, position: int, limit: int = 0) -> DataFrame:
    """Events after a global position, in order; limit 0 or less: all."""
    tail = events.where(F.col("global_pos") > position).orderBy("global_pos")
    return tail.limit(limit) if limit > 0 else tail


def load_stream(events: DataFrame, stream) -> DataFrame:
    return events.where(F.col("stream") == stream).orderBy("version")


def replay(events: DataFrame) -> DataFrame:
    """(stream, balance, version, closed): the aggregate of each stream."""
    return events.groupBy("stream").agg(F.sum(delta()).cast("long").alias("balance"), F.max("version").alias("version"), F.bool_or(F.col("type") == "Closed").alias("closed"))


def running_balance(events: DataFrame) -> DataFrame:
    """`events` with the balance after each."""
    return events.withColumn("balance", F.sum(delta()).over(Window.partitionBy("stream").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def project(events: DataFrame) -> DataFrame:
    """(stream, balance): a read model in which Opened sets the balance to 0 and Closed removes the row.

    Amounts after a Closed start a row again, from 0.
    """
    reset = F.max(F.when(F.col("type").isin("Opened", "Closed"), F.col("global_pos")))
    last = events.groupBy("stream").agg(reset.alias("reset"), F.max_by("type", F.when(F.col("type").isin("Opened", "Closed"), F.col("global_pos"))).alias("by"))
    later = events.join(last, "stream").where(F.col("type").isin("Deposited", "Withdrawn") & (F.col("reset").isNull() | (F.col("global_pos") > F.col("reset"))))
    sums = later.groupBy("stream").agg(F.sum(delta()).alias("moved"), F.count(F.lit(1)).alias("n"))
    kept = last.join(sums, "stream", "left").where((F.col("by") != "Closed") | F.col("by").isNull() | (F.col("n") > 0))
    return kept.select("stream", F.coalesce("moved", F.lit(0)).cast("long").alias("balance"))


def catch_up(projection: DataFrame, events: DataFrame, checkpoint: int) -> DataFrame:
    """A projection (stream, balance) brought from a checkpoint up to the end of `events`."""
    tail = events.where(F.col("global_pos") > checkpoint)
    carried = projection.select("stream", F.lit("Opened").alias("type"), F.lit(-1).cast("long").alias("global_pos"), F.lit(0).cast("long").alias("amount"))
    paid = projection.select("stream", F.lit("Deposited").alias("type"), F.lit(0).cast("long").alias("global_pos"), F.col("balance").alias("amount"))
    return project(carried.unionByName(paid).unionByName(tail.select("stream", "type", (F.col("global_pos") + 1).alias("global_pos"), "amount")))


def snapshot_and_tail(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(stream, balance, version, closed) from snapshots of the same shape and the events after them."""
    tail = events.join(snapshots.select("stream", F.col("version").alias("seen")), "stream", "left").where(F.col("seen").isNull() | (F.col("version") > F.col("seen")))
    both = snapshots.select("stream", "balance", "version", "closed").unionByName(replay(tail))
    return both.groupBy("stream").agg(F.sum("balance").cast("long").alias("balance"), F.max("version").alias("version"), F.bool_or("closed").alias("closed"))


def audit_appends(attempts: DataFrame, order: list[str]) -> DataFrame:
    """`attempts` (stream, expected) with the version found; conflict: it isn't the one expected."""
    found = F.row_number().over(Window.partitionBy("stream").orderBy(*order)) - 1
    return attempts.withColumn("found", found.cast("long")).withColumn("conflict", F.col("expected") != F.col("found"))


def judge_commands(events: DataFrame) -> DataFrame:
    """`events` with the balance before each and whether the rules allow it: amounts are positive, a closed account
    takes nothing, a withdrawal has to be covered, closing needs a balance of 0."""
    before = Window.partitionBy("stream").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    state = events.withColumn("before", F.coalesce(F.sum(delta()).over(before), F.lit(0)).cast("long")).withColumn("was_closed", F.coalesce(F.bool_or(F.col("type") == "Closed").over(before), F.lit(False)))
    rule = F.when(F.col("type") == "Deposited", F.col("amount") > 0).when(F.col("type") == "Withdrawn", (F.col("amount") > 0) & (F.col("before") >= F.col("amount"))).when(F.col("type") == "Closed", F.col("before") == 0).otherwise(True)
    return state.withColumn("allowed", rule & ~F.col("was_closed"))


def describe(stream: Column, version: Column, kind: Column, data: Column) -> Column:
    """`stream@version kind{k=v ...}` with the keys of a map in order."""
    pairs = F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(stream.cast("string"), F.lit("@"), version.cast("string"), F.lit(" "), kind, F.lit("{"), F.array_join(pairs, " "), F.lit("}"))
