"""Causal order: vector clocks, siblings, Lamport and hybrid clocks, sortable ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the id layout: 41 bits of milliseconds from the epoch, 10 of the node, 12 of a sequence.
ID_EPOCH_MS, NODE_BITS, SEQUENCE_BITS = 1_700_000_000_000, 10, 12


def ahead(a: Column, b: Column) -> Column:
    """Whether some counter of clock `a` exceeds that of `b`; a missing counter is 0."""
    return F.exists(F.map_entries(a), lambda e: e["value"] > F.coalesce(F.try_element_at(b, e["key"]), F.lit(0)))


def compare(a: Column, b: Column) -> Column:
    """equal, before, after or concurrent."""
    return F.when(ahead(a, b) & ahead(b, a), "concurrent").when(ahead(a, b), "after").when(ahead(b, a), "before").otherwise("equal")


def merge(a: Column, b: Column) -> Column:
    """Counter by counter the larger."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def merge_all(clocks: DataFrame, key: str, clock: str = "clock") -> DataFrame:
    """(key, clock): all clocks of a key merged."""
    counters = clocks.select(key, F.explode(clock).alias("node", "n")).groupBy(key, "node").agg(F.max("n").alias("n"))
    return counters.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias(clock))


def bump(clock: Column, node: str) -> Column:
    """A clock with one more at `node`."""
    return F.map_concat(F.map_filter(clock, lambda k, v: k != F.lit(node)), F.create_map(F.lit(node), F.coalesce(F.try_element_at(clock, F.lit(node)), F.lit(0)).cast("long") + 1))


def format_clock(clock: Column) -> Column:
    """`{a:1,b:2}`, by node."""
    pairs = F.transform(F.array_sort(F.map_entries(clock)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def siblings(versions: DataFrame, key: str, order: str, clock: str = "clock") -> DataFrame:
    """Versions of each key that no other version of it supersedes; of equal clocks the last in `order` stays."""
    text = format_clock(F.col(clock))
    last = versions.withColumn("__n", F.row_number().over(Window.partitionBy(key, text).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    other = last.select(F.col(key).alias("__key"), F.col(clock).alias("__clock"))
    beaten = (F.col(key) == F.col("__key")) & (compare(F.col(clock), F.col("__clock")) == "before")
    return last.join(other, beaten, "left_anti")


def anti_entropy(replicas: DataFrame, key: str, order: str, clock: str = "clock", node: str = "node") -> DataFrame:
    """What every replica holds once all have met: the siblings of each key, for each node."""
    return siblings(replicas, key, order, clock).drop(node).crossJoin(F.broadcast(replicas.select(node).distinct()))


def visible_values(found: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Siblings without tombstones; these are hidden only after the comparison."""
    return found.where(~F.col(deleted))


def preference_list(key_hash: Column, n: int, replicas: int) -> Column:
    """Numbers of the `replicas` nodes that hold a key, from its own on."""
    return F.transform(F.sequence(F.lit(0), F.lit(min(n, replicas) - 1)), lambda i: F.pmod(key_hash + i, F.lit(n)).cast("int"))


def quorum_overlap(n: int, w: int, r: int) -> bool:
    return w + r > n


def quorum_read(replicas: DataFrame, preferences: DataFrame, live: DataFrame, r: int, key: str, order: str) -> DataFrame:
    """Siblings among what the first `r` live nodes of each key's preference list hold.

    preferences (key, node, place); live (node). A key with fewer than r live nodes gives nothing.
    """
    w = Window.partitionBy(key).orderBy("place")
    asked = preferences.join(live, "node").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= r)
    enough = asked.groupBy(key).agg(F.count(F.lit(1)).alias("__asked")).where(F.col("__asked") >= r)
    return siblings(replicas.join(asked.select(key, "node"), [key, "node"], "left_semi").join(enough.select(key), key, "left_semi"), key, order)


def deliver_hints(replicas: DataFrame, hints: DataFrame, recovered: str, key: str, order: str) -> DataFrame:
    """A recovered node's versions after the hinted writes for it (dest) were handed over."""
    own = replicas.where(F.col("node") == recovered)
    sent = hints.where(F.col("dest") == recovered).drop("dest").withColumn("node", F.lit(recovered))
    return siblings(own.unionByName(sent.select(*own.columns)), key, order)


def lamport(events: DataFrame, order: str) -> DataFrame:
    """`events` (node, kind, message) of all nodes in an order in which a message is sent before it is received, with
    Lamport time and vector clock. kind: local, send or recv. A fold, so one run of events is one task's work; `run`
    tells independent runs apart."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        time: dict[str, int] = {}
        vector: dict[str, dict[str, int]] = {}
        sent: dict[str, tuple[int, dict[str, int]]] = {}
        out = []
        for e in frame.itertuples(index=False):
            own, at = dict(vector.get(e.node, {})), time.get(e.node, 0)
            if e.kind == "recv" and e.message in sent:
                other_at, other = sent[e.message]
                at = max(at, other_at)
                own = {n: max(own.get(n, 0), other.get(n, 0)) for n in own.keys() | other.keys()}
            own[e.node] = own.get(e.node, 0) + 1
            time[e.node], vector[e.node] = at + 1, own
            if e.kind == "send":
                sent[e.message] = (at + 1, own)
            out.append((at + 1, "{" + ",".join(f"{n}:{c}" for n, c in sorted(own.items())) + "}"))
        return frame.assign(lamport=[x for x, _ in out], vector=[x for _, x in out])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return events.groupBy("run").applyInPandas(fold, f"{fields}, lamport long, vector string")


def hlc_now(readings: DataFrame, node: str, order: list[str], wall: str = "wall_ms") -> DataFrame:
    """`readings` with the hybrid clock's (physical, logical): physical is the largest wall time of the node so far,
    logical counts readings since it last rose."""
    upto = Window.partitionBy(node).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = readings.withColumn("physical", F.max(wall).over(upto))
    return marked.withColumn("logical", (F.row_number().over(Window.partitionBy(node, "physical").orderBy(*order)) - 1).cast("long"))


def hlc_update(physical: Column, logical: Column, remote_physical: Column, remote_logical: Column, wall: Column) -> Column:
    """The clock after a message: never below its own, the remote's or the wall's time."""
    top = F.greatest(physical, remote_physical, wall)
    own, theirs = F.when(physical == top, logical), F.when(remote_physical == top, remote_logical)
    return F.struct(top.alias("physical"), (F.coalesce(F.greatest(own, theirs), F.lit(-1)) + 1).cast("long").alias("logical"))


def skew_rejected(remote_ms: Column, wall_ms: Column, most: int) -> Column:
    return remote_ms - wall_ms > most


def hlc_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two (physical, logical) structs."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def wall_time(physical: Column) -> Column:
    return F.timestamp_millis(physical)


def sortable_id(ms: Column, node: Column, sequence: Column) -> Column:
    return F.shiftleft(ms - ID_EPOCH_MS, NODE_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(node.cast("long"), SEQUENCE_BITS)).bitwiseOR(sequence.cast("long"))


def decode_id(id_: Column) -> tuple[Column, Column, Column]:
    """(ms, node, sequence)."""
    low = lambda bits: F.lit((1 << bits) - 1)
    return F.shiftright(id_, NODE_BITS + SEQUENCE_BITS) + ID_EPOCH_MS, F.shiftright(id_, SEQUENCE_BITS).bitwiseAND(low(NODE_BITS)), id_.bitwiseAND(low(SEQUENCE_BITS))


def assign_ids(events: DataFrame, node: str, ms: str, order: list[str], out: str = "id") -> DataFrame:
    """`events` with a sortable id: numbered within node and millisecond; over 4096 in one go on into later ones.

    An event that finds its millisecond taken by the overflow of an earlier one queues behind it, so with k-th place
    among the node's events in order the slot is k + the largest (first slot of a millisecond - events before it).
    """
    most = 1 << SEQUENCE_BITS
    upto = Window.partitionBy(node).orderBy(ms, *order)
    place = F.row_number().over(upto) - 1
    gap = F.max((F.col(ms) - ID_EPOCH_MS) * most - F.col("__place")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    slots = events.withColumn("__place", place.cast("long")).withColumn("__slot", F.col("__place") + gap)
    value = sortable_id(F.shiftright("__slot", SEQUENCE_BITS) + ID_EPOCH_MS, F.col(node), F.col("__slot").bitwiseAND(F.lit(most - 1)))
    return slots.withColumn(out, value).drop("__place", "__slot")


def rolled_back(node: str, order: list[str], ms: str) -> Column:
    """Whether a reading lies before an earlier one of its node."""
    return F.coalesce(F.col(ms) < F.max(ms).over(Window.partitionBy(node).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
