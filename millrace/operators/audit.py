"""Queries over histories of replication and transactions: quorums, lag, lost writes, safety, two-phase commit, sagas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.versioned import latest


def quorum_commit(matches: DataFrame, group: str | None = None) -> DataFrame:
    """(group,) n, commit_idx: the index that a majority of nodes has, from (node, idx). A group has few nodes."""
    keys = [group] if group else []
    sorted_ = F.sort_array(F.collect_list("idx"), asc=False)
    return matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sorted_.alias("all")).select(*keys, "n", F.element_at("all", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("commit_idx"))


def own_term_commit(commit: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """A quorum index counts only if the entry there is of the current term; else nothing new is committed (0)."""
    met = commit.join(log.select(F.col("idx").alias("commit_idx"), "term"), "commit_idx", "left")
    return met.select("n", F.when(F.col("term") == term, F.col("commit_idx")).otherwise(0).alias("commit_idx"))


def replication_lag(applied: DataFrame, leader_idx: int | None = None) -> DataFrame:
    """(node, applied, lag) against the leader's index, or the largest."""
    top = applied.sparkSession.range(1).select(F.lit(leader_idx).cast("long").alias("top")) if leader_idx is not None else applied.agg(F.max("applied").alias("top"))
    return applied.crossJoin(F.broadcast(top)).select("node", "applied", (F.col("top") - F.col("applied")).alias("lag"))  # one row is broadcast


def ack_counts(acks: DataFrame, needed: int) -> DataFrame:
    """(idx, acks, done): how many nodes hold each entry."""
    return acks.groupBy("idx").agg(F.countDistinct("node").alias("acks")).withColumn("done", F.col("acks") >= needed)


def needed_acks(mode: str, nodes: int) -> int:
    """Followers and leader that a write waits for: async 1, quorum a majority, all all."""
    return {"async": 1, "quorum": nodes // 2 + 1, "all": nodes}[mode]


def may_serve(mode: str, is_leader: Column, applied: Column, session: Column) -> Column:
    """Whether a node may answer a read: leader only, any node, or one that has what the session wrote."""
    return {"leader": is_leader, "any": F.lit(True), "session": applied >= session}[mode]


def failover_loss(log: DataFrame, dead: DataFrame) -> DataFrame:
    """Committed entries that the new leader lacks: the live node with the longest log, then the least name, leads.

    log: (node, idx, term, key, value, committed).
    """
    survivors = log.join(F.broadcast(dead), "node", "left_anti")
    leader = survivors.groupBy("node").agg(F.max("idx").alias("last")).orderBy(F.desc("last"), "node").limit(1).select(F.col("node").alias("leader"))
    kept = survivors.join(F.broadcast(leader), F.col("node") == F.col("leader")).select("idx", "term")
    committed = log.where("committed").select("idx", "term", "key", "value").distinct()
    return committed.join(kept, ["idx", "term"], "left_anti")


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the first index at which two logs (idx, term) have different terms, null if they agree."""
    met = a.select("idx", F.col("term").alias("ta")).join(b.select("idx", F.col("term").alias("tb")), "idx")
    return met.agg(F.min(F.when(F.col("ta") != F.col("tb"), F.col("idx"))).alias("idx"))


def up_to_date(last_term: Column, last_idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Whether a candidate's log is at least as new as a voter's."""
    return F.struct(last_term, last_idx) >= F.struct(own_term, own_idx)


def unsafe_terms(leaders: DataFrame) -> DataFrame:
    """(term, leaders): terms with more than one leader; has to be empty."""
    return leaders.groupBy("term").agg(F.countDistinct("node").alias("leaders")).where("leaders > 1")


def decide(participants: DataFrame, votes: DataFrame) -> DataFrame:
    """(txn, decision): commit if all participants voted so; a missing vote is a no."""
    met = participants.join(votes, ["txn", "participant"], "left")
    return met.groupBy("txn").agg(F.when(F.bool_and(F.coalesce(F.col("vote") == "commit", F.lit(False))), "commit").otherwise("abort").alias("decision"))


def in_doubt(log: DataFrame) -> DataFrame:
    """(txn, participant): prepared, and without a decision."""
    prepared = log.where("action = 'prepare'").select("txn", "participant").distinct()
    return prepared.join(log.where("action in ('commit', 'abort')").select("txn", "participant"), ["txn", "participant"], "left_anti")


def run_sagas(steps: DataFrame) -> DataFrame:
    """(saga, n, action, name): steps in order up to the first that fails, then compensations of the done ones, last
    first. steps: (saga, step, name, ok)."""
    upto = Window.partitionBy("saga").orderBy("step")
    failed = F.coalesce(F.max((~F.col("ok")).cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = steps.withColumn("__after", failed).where("__after = 0").drop("__after")
    whole = Window.partitionBy("saga")
    judged = run.withColumn("__failed", F.max((~F.col("ok")).cast("int")).over(whole)).withColumn("__steps", F.max("step").over(whole))
    forward = judged.select("saga", F.col("step").cast("long").alias("at"), F.when(F.col("ok"), "do").otherwise("fail").alias("action"), "name")
    back = judged.where("__failed = 1 and ok").select("saga", (2 * F.col("__steps") - F.col("step") + 1).cast("long").alias("at"), F.lit("undo").alias("action"), "name")
    return forward.unionByName(back).select("saga", F.row_number().over(Window.partitionBy("saga").orderBy("at")).alias("n"), "action", "name")


def state_at(log: DataFrame, idx: int | None = None) -> DataFrame:
    """(key, value) of a key-value machine after the log (idx, op, key, value) up to an index; reads change nothing."""
    own = log.where("op in ('put', 'delete')")
    own = own.where(F.col("idx") <= idx) if idx is not None else own
    return latest(own.select("key", "idx", "op", "value"), "key", ["idx"]).where("op = 'put'").select("key", "value")
