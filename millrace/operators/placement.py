"""Key placement: modulo, hash rings, key ranges; movement, imbalance and rebalancing."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import ring_hash

VNODES = 128
#: Most ring points that are broadcast: 16 bytes each, and the node's name.
MOST_POINTS = 1_000_000


def modulo_node(hashed: Column, nodes: list[str]) -> Column:
    """The node of a hash by modulo; null without nodes."""
    return F.element_at(F.array(*map(F.lit, nodes)), (F.pmod(hashed, F.lit(len(nodes))) + 1).cast("int")) if nodes else F.lit(None).cast("string")


def ring_points(spark: SparkSession, nodes: list[str], vnodes: int = VNODES) -> DataFrame:
    """(point, node): each node's places on the ring; of equal points the least node's."""
    names = spark.createDataFrame([(n,) for n in nodes], "node string")
    placed = names.select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    return placed.select(ring_hash(F.concat("node", F.lit("#"), F.col("v").cast("string"))).alias("point"), "node").groupBy("point").agg(F.min("node").alias("node"))


def remove_node(points: DataFrame, node: str) -> DataFrame:
    return points.where(F.col("node") != node)


def ring_locate(keys: DataFrame, hashed: str, points: DataFrame, out: str = "node") -> DataFrame:
    """`keys` with the node of the first ring point at or after their hash, the first point of all past the last.

    The ring is as small as the cluster that it describes; it is checked against MOST_POINTS and goes to all tasks,
    which search it in Arrow batches. An empty ring places nothing (null).
    """
    ring = points.select("point", "node").orderBy("point").limit(MOST_POINTS + 1).collect()
    if len(ring) > MOST_POINTS:
        raise ValueError(f"a ring of more than {MOST_POINTS} points")
    at, names = np.array([r["point"] for r in ring], np.int64), np.array([r["node"] for r in ring] + [None], object)

    @F.pandas_udf("string")
    def locate(h: pd.Series) -> pd.Series:
        places = np.searchsorted(at, h.fillna(0).to_numpy(np.int64))
        return pd.Series(names[places % max(1, len(at))] if len(at) else names[[-1] * len(h)]).where(h.notna(), None)

    return keys.withColumn(out, locate(F.col(hashed)))


def ring_locate_sql(keys: DataFrame, key: str, hashed: str, points: DataFrame) -> DataFrame:
    """(key, node) by joins only, for a handful of points: the cost is keys times points."""
    met = keys.select(key, hashed).crossJoin(F.broadcast(points))
    ahead = F.min_by("node", F.when(F.col("point") >= F.col(hashed), F.col("point")))
    return met.groupBy(key, hashed).agg(F.coalesce(ahead, F.min_by("node", "point")).alias("node"))


def distribution(placed: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, keys) for all nodes, idle ones too."""
    counts = placed.groupBy(node).agg(F.count(F.lit(1)).alias("keys"))
    return nodes.select(node).join(counts, node, "left").select(node, F.coalesce("keys", F.lit(0)).alias("keys"))


def load_imbalance(counts: DataFrame) -> DataFrame:
    """One row: imbalance, the largest share over the mean share of all nodes; 0 without keys."""
    return counts.agg(F.coalesce(F.try_divide(F.max("keys"), F.sum("keys") / F.count(F.lit(1))), F.lit(0.0)).alias("imbalance"))


def movement(keys: DataFrame, before: str, after: str) -> DataFrame:
    """One row: keys, moved, share."""
    moved = F.count_if(~F.col(before).eqNullSafe(F.col(after)))
    return keys.agg(F.count(F.lit(1)).alias("keys"), moved.alias("moved"), F.coalesce(F.try_divide(moved, F.count(F.lit(1))), F.lit(0.0)).alias("share"))


def keys_by_node(placed: DataFrame, key: str, node: str = "node") -> DataFrame:
    """(node, keys, first, last): a bounded view of what each node holds."""
    return placed.groupBy(node).agg(F.count(F.lit(1)).alias("keys"), F.min(key).alias("first"), F.max(key).alias("last"))


def even_ranges(spark: SparkSession, count: int, nodes: list[str], keys: int, width: int = 5) -> DataFrame:
    """(start, end, node): `count` ranges over zero-padded keys k00000..; the last end is empty, the top."""
    bound = lambda i: F.when((i > 0) & (i < count), F.format_string(f"k%0{width}d", i * (keys // count))).otherwise("")
    numbers = spark.range(count).withColumn("id", F.col("id").cast("int"))
    return numbers.select(bound(F.col("id")).alias("start"), bound(F.col("id") + 1).alias("end"), modulo_node(F.col("id"), nodes).alias("node"))


def in_range(key: Column) -> Column:
    return (key >= F.col("start")) & ((F.col("end") == "") | (key < F.col("end")))


def range_locate(keys: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """`keys` with the node of the range that holds them. Ranges don't overlap; there are as many as the cluster has."""
    return keys.join(F.broadcast(ranges), in_range(F.col(key)), "left")


def split_range(ranges: DataFrame, at: str, node: str) -> DataFrame:
    """The range that holds `at` cut in two there; the upper part goes to `node`. A bound that is there stays."""
    cut = in_range(F.lit(at)) & (F.col("start") != at)
    parts = F.when(cut, F.array(F.struct("start", F.lit(at).alias("end"), "node"), F.struct(F.lit(at).alias("start"), "end", F.lit(node).alias("node")))).otherwise(F.array(F.struct("start", "end", "node")))
    return ranges.select(F.explode(parts).alias("r")).select("r.*")


def merge_range(ranges: DataFrame, start: str) -> DataFrame:
    """The range that begins at `start` joined with the one after it, under the lower one's node."""
    low, rest = ranges.where(F.col("start") == start), ranges.where(F.col("start") != start)
    upper = rest.join(F.broadcast(low.select(F.col("end").alias("__end"))), (F.col("start") == F.col("__end")) & (F.col("__end") != ""), "left_semi")
    tops = upper.select(F.col("end").alias("__top"), F.col("start").alias("__at"))
    joined = low.join(F.broadcast(tops), F.col("end") == F.col("__at"), "left").select("start", F.coalesce("__top", "end").alias("end"), "node")
    return joined.unionByName(rest.join(F.broadcast(low.select(F.col("end").alias("__end"))), (F.col("start") == F.col("__end")) & (F.col("__end") != ""), "left_anti"))


def rebalance(ranges: list[tuple[str, str, str]], nodes: list[str]) -> tuple[list[tuple[str, str, str]], int]:
    """Ranges dealt anew over `nodes` with as few moves as possible, and the number of moves.

    Each node ends with its even share; the first nodes have one more where it doesn't divide. The table has a row per
    range of the cluster, and the choice is a sequence, so it is made on the driver.
    """
    if not nodes:
        return ranges, 0
    share = {n: len(ranges) // len(nodes) + (i < len(ranges) % len(nodes)) for i, n in enumerate(nodes)}
    held, out, homeless = Counter(), [], []
    for i, (start, end, node) in enumerate(ranges):
        if node in share and held[node] < share[node]:
            held[node] += 1
            out.append((start, end, node))
        else:
            out.append((start, end, ""))
            homeless.append(i)
    for i in homeless:
        node = next(n for n in nodes if held[n] < share[n])
        held[node] += 1
        out[i] = (*out[i][:2], node)
    return out, len(homeless)


def sample_keys(spark: SparkSession, count: int, prefix: str = "key-", width: int = 0) -> DataFrame:
    """(key): prefix and number, zero-padded to `width`."""
    return spark.range(count).select(F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), width, "0") if width else F.col("id").cast("string")).alias("key"))
