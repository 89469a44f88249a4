"""Versioned tables: last write wins, compaction, ordered scans, snapshots, garbage collection and conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last write of each key, tombstones too. Partial maxima are taken before the shuffle."""
    rest = [c for c in writes.columns if c != key and c not in order]
    best = writes.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("w"))
    return best.select(key, *[F.col(f"w.{c}").alias(c) for c in (*order, *rest)])


def live(writes: DataFrame, key: str, order: list[str], deleted: str = "is_delete") -> DataFrame:
    """The last write of each key whose last write isn't a delete; the winner is chosen first."""
    return latest(writes, key, order).where(~F.col(deleted))


def compact(writes: DataFrame, key: str, order: list[str], deleted: str = "is_delete", last_level: bool = True) -> DataFrame:
    """What a compaction keeps: the last write of each key; tombstones only go at the last level, where nothing lies
    below that they hide. Ranges of keys stay apart in files if the result is written with `by_ranges`."""
    return live(writes, key, order, deleted) if last_level else latest(writes, key, order)


def by_ranges(rows: DataFrame, key: str, files: int) -> DataFrame:
    """`rows` in files whose key ranges don't overlap, sorted, so that their statistics prune point and range reads."""
    return rows.repartitionByRange(files, key).sortWithinPartitions(key)


def merge_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, newest first: of equal keys that of the newest source."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    union = ranked[0]
    for s in ranked[1:]:
        union = union.unionByName(s)
    return union.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__rank"))).where("__n = 1").drop("__rank", "__n")


def get(writes: DataFrame, key: str, order: list[str], value) -> DataFrame:
    """The live row of one key; no row if there is none. The filter reaches the scan."""
    return live(writes.where(F.col(key) == value), key, order)


def seek(rows: DataFrame, key: str, target, limit: int) -> DataFrame:
    """The first `limit` rows with a key of `target` or more, in order."""
    return rows.where(F.col(key) >= target).orderBy(key).limit(limit)


def level_budgets(tables: DataFrame, base: int, ratio: int, l0_most: int = 4) -> DataFrame:
    """(level, tables, bytes, compact): whether a level is due, from a manifest (level, bytes)."""
    sums = tables.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("bytes").alias("bytes"))
    budget = F.lit(float(base)) * F.pow(F.lit(float(ratio)), F.col("level") - 1)
    return sums.withColumn("compact", F.when(F.col("level") == 0, F.col("tables") >= l0_most).otherwise(F.col("bytes") > budget))


def overlapping(tables: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of tables whose key ranges [low, high] meet, from two manifests (table, low, high)."""
    a, b = tables.alias("a"), other.alias("b")
    return a.join(F.broadcast(b), (F.col("a.low") <= F.col("b.high")) & (F.col("a.high") >= F.col("b.low"))).select(F.col("a.table").alias("a"), F.col("b.table").alias("b"))


def checked_records(records: DataFrame, payload: str, crc: str, torn: Column | None = None) -> DataFrame:
    """Log records whose CRC-32 agrees. A torn record at the end is dropped, any other wrong sum is an error."""
    right = F.crc32(payload) == F.col(crc)
    bad = F.raise_error(F.lit("a record's checksum is wrong")).cast("boolean")
    return records.where(F.when(right, True).when(torn if torn is not None else F.lit(False), False).otherwise(bad))


def versions(writes: DataFrame, key: str, order: list[str], start: str = "start_ts") -> DataFrame:
    """`writes` with end_ts, the start of the key's next version, 0 for the newest."""
    return writes.withColumn("end_ts", F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(start, *order)), F.lit(0).cast("long")))


def visible(ts: Column | int) -> Column:
    """Versions that a snapshot at `ts` sees, deletes among them."""
    ts = F.lit(ts) if isinstance(ts, int) else ts
    return (F.col("start_ts") <= ts) & ((F.col("end_ts") == 0) | (F.col("end_ts") > ts))


def snapshot(history: DataFrame, ts: int) -> DataFrame:
    return history.where(visible(ts) & ~F.col("deleted"))


def overlay(snap: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """A snapshot under a transaction's own writes (own has `deleted`)."""
    return snap.join(own.select(key), key, "left_anti").select(*snap.columns).unionByName(own.where(~F.col("deleted")).select(*snap.columns))


def history_text(history: DataFrame, key: str, value: str) -> DataFrame:
    """(key, versions, chain): the versions of each key in order, as `start..end=value`, `del` for deletes."""
    one = F.concat(F.col("start_ts").cast("string"), F.lit(".."), F.col("end_ts").cast("string"), F.lit("="), F.when(F.col("deleted"), "del").otherwise(F.col(value).cast("string")))
    rows = history.groupBy(key).agg(F.count(F.lit(1)).alias("versions"), F.array_sort(F.collect_list(F.struct("start_ts", one.alias("x")))).alias("all"))
    return rows.select(key, "versions", F.array_join(F.transform("all", lambda v: v["x"]), " ").alias("chain"))


def collect_garbage(history: DataFrame, oldest_read: int) -> DataFrame:
    """`history` without versions that no snapshot from `oldest_read` on sees. Newest versions stay, deletes too."""
    return history.where((F.col("end_ts") == 0) | (F.col("end_ts") > oldest_read))


def version_stats(history: DataFrame, key: str) -> DataFrame:
    """One row: keys, versions, live (newest and no delete)."""
    return history.agg(F.countDistinct(key).alias("keys"), F.count(F.lit(1)).alias("versions"), F.count_if((F.col("end_ts") == 0) & ~F.col("deleted")).alias("live"))


def conflicts(touched: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows of `touched` (txn, read_ts, commit_ts, key) whose key got a version after the snapshot and before the commit.

    Snapshots and versions of a key pass in descending time, so each snapshot knows the first version after it.
    """
    asked = touched.select(F.col(key).alias("k"), F.col("read_ts").alias("at"), F.lit(None).cast("long").alias("start"), F.struct("*").alias("row"))
    known = history.select(F.col(key).alias("k"), F.col("start_ts").alias("at"), F.col("start_ts").cast("long").alias("start"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    down = Window.partitionBy("k").orderBy(F.desc("at"), F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.union(known).withColumn("next", F.last("start", ignorenulls=True).over(down))
    return met.where("row is not null and next < row.commit_ts").select("row.*")


def write_skew(txns: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(a, b): transactions that overlap in time, each of which read what the other wrote, and wrote nothing in common.

    txns (txn, read_ts, commit_ts); reads and writes (txn, key). Joins are on keys and stretches of time as long as the
    longest transaction, so that only transactions near in time meet.
    """
    width = txns.agg(F.greatest(F.max(F.col("commit_ts") - F.col("read_ts")), F.lit(1))).first()[0] or 1
    stretch = F.explode(F.sequence(F.floor(F.col("read_ts") / width), F.floor(F.col("commit_ts") / width))).alias("stretch")
    timed = lambda touched: touched.join(txns, "txn").select("txn", "key", "read_ts", "commit_ts", stretch)
    near = [F.col("x.key") == F.col("y.key"), F.col("x.stretch") == F.col("y.stretch"), F.col("x.read_ts") < F.col("y.commit_ts"), F.col("y.read_ts") < F.col("x.commit_ts"), F.col("x.txn") != F.col("y.txn")]
    pairs = lambda left, right: left.alias("x").join(right.alias("y"), near).select(F.col("x.txn").alias("a"), F.col("y.txn").alias("b")).distinct()
    read, wrote = timed(reads), timed(writes)
    met = pairs(read, wrote)
    both = met.where("a < b").join(met.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    return both.join(pairs(wrote, wrote), ["a", "b"], "left_anti")


def replay_commits(txns: DataFrame, group: str = "db") -> DataFrame:
    """(group, txn, committed, reason): first committer wins, over transactions in commit order.

    txns: group, txn, iso (snapshot or serializable), read_ts, commit_ts, reads (array), writes (array). A write to a
    key that was committed after the snapshot is a conflict; under serializable so is a read of one, unless the
    transaction also writes it. One group is one database: its commits are a sequence, so they are one task's work.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frame = frames.sort_values(["commit_ts", "txn"])
        last: dict[str, int] = {}
        out = []
        for t in frame.itertuples(index=False):
            changed = [k for k in t.writes if last.get(k, -1) > t.read_ts]
            read = [k for k in t.reads if k not in set(t.writes) and last.get(k, -1) > t.read_ts] if t.iso == "serializable" else []
            reason = f"write {min(changed)}" if changed else f"read {min(read)}" if read else None
            if reason is None:
                last.update(dict.fromkeys(t.writes, t.commit_ts))
            out.append((getattr(t, group), t.txn, reason is None, reason))
        return pd.DataFrame(out, columns=[group, "txn", "committed", "reason"])

    kind = txns.schema[group].dataType.simpleString()
    return txns.groupBy(group).applyInPandas(fold, f"{group} {kind}, txn long, committed boolean, reason string")
