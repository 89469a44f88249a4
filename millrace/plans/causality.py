"""Queries of causal order, replication histories and transactions across participants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import audit as A
from millrace.operators import causal as K
from millrace.operators.windowing import micros
from millrace.plans.inputs import WRITES, writes
from millrace.sources.tables import table

KINDS = ("click", "purchase", "view")


def clocks(spark, d):
    """Per user and event: a clock of how many events of three kinds came so far."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.count_if(F.col("event_type") == k).over(w).alias(k) for k in KINDS]
    rows = table(spark, d, "events").select("user_id", "event_id", *counts)
    return rows.select("user_id", "event_id", F.create_map(*[x for k in KINDS for x in (F.lit(k), F.col(k))]).alias("clock"))


CLOCKS = f"""clocks AS (SELECT user_id, event_id, {', '.join(f"count(*) FILTER (event_type = '{k}') OVER w AS {k}" for k in KINDS)}
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


def vector_compare(spark, d):
    """Each event's clock against that of the next event of the next user."""
    a = clocks(spark, d)
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("event_id").alias("other"), F.col("clock").alias("theirs"))
    first = b.groupBy("user_id").agg(F.min_by("theirs", "other").alias("theirs"), F.max_by("theirs", "other").alias("last"))
    met = a.join(first, "user_id")
    return met.select("event_id", K.compare(F.col("clock"), F.col("theirs")).alias("first"), K.compare(F.col("clock"), F.col("last")).alias("last"))


def vector_merge(spark, d):
    """Clocks of users in groups of ten merged."""
    return K.merge_all(clocks(spark, d).withColumn("grp", F.floor(F.col("user_id") / 10)), "grp").select("grp", K.format_clock(F.col("clock")).alias("clock"))


def last_clocks(spark, d):
    return clocks(spark, d).groupBy("user_id").agg(F.max_by("clock", "event_id").alias("clock"), F.max("event_id").alias("event_id")).withColumn("key", F.floor(F.col("user_id") / 10))


def siblings(spark, d):
    """Of the last clocks of ten users those that none of the others supersedes."""
    return K.siblings(last_clocks(spark, d), "key", "event_id").select("key", "user_id", K.format_clock(F.col("clock")).alias("clock"))


def anti_entropy(spark, d):
    """All replicas hold the siblings once they have met."""
    rows = last_clocks(spark, d).withColumn("node", F.concat(F.lit("n"), F.pmod("user_id", F.lit(3)).cast("string")))
    return K.anti_entropy(rows, "key", "event_id").select("node", "key", "user_id")


def quorum_read(spark, d):
    """Reads of two of the three nodes of a key's preference list, while node n1 is down."""
    rows = last_clocks(spark, d).withColumn("node", F.concat(F.lit("n"), F.pmod("user_id", F.lit(5)).cast("string")))
    wanted = rows.select("key").distinct().select("key", F.posexplode(K.preference_list(F.col("key"), 5, 3)).alias("place", "at")).select("key", "place", F.concat(F.lit("n"), F.col("at").cast("string")).alias("node"))
    live = spark.createDataFrame([("n0",), ("n2",), ("n3",), ("n4",)], "node string")
    return K.quorum_read(rows, wanted, live, 2, "key", "event_id").select("key", "user_id")


def readings(spark, d):
    """Wall readings of 16 nodes, some of which go back by a second."""
    ms = F.floor(micros(F.col("ts")) / 1000) - F.when(F.col("event_id") % 7 == 0, 10_000_000).otherwise(0)
    return table(spark, d, "events").select(F.pmod("user_id", F.lit(16)).alias("node"), "event_id", ms.alias("wall_ms"))


READINGS = "readings AS (SELECT user_id % 16 AS node, event_id, epoch_us(ts) // 1000 - CASE WHEN event_id % 7 = 0 THEN 10000000 ELSE 0 END AS wall_ms FROM events)"


def hlc_now(spark, d):
    return K.hlc_now(readings(spark, d), "node", ["event_id"]).select("event_id", "physical", "logical")


def clock_rollback(spark, d):
    return readings(spark, d).select("event_id", K.rolled_back("node", ["event_id"], "wall_ms").alias("back"))


def hlc_update(spark, d):
    """A node's clock after a message with the clock of the node's reading before."""
    w = Window.partitionBy("node").orderBy("event_id")
    rows = readings(spark, d).select("event_id", "wall_ms", F.coalesce(F.lag("wall_ms").over(w), F.lit(0)).alias("own"), F.coalesce(F.lag("wall_ms", 2).over(w), F.lit(0)).alias("remote"))
    new = rows.select("event_id", K.hlc_update(F.col("own"), F.lit(3).cast("long"), F.col("remote"), F.lit(5).cast("long"), F.col("wall_ms")).alias("c"), K.skew_rejected(F.col("remote"), F.col("wall_ms"), 500).alias("rejected"))
    return new.select("event_id", "c.physical", "c.logical", "rejected")


def snowflake_encode_decode(spark, d):
    """Ids of events at ten-second grain, so that some share a millisecond, and what they decode to."""
    ms = F.floor(F.floor(micros(F.col("ts")) / 1000) / 10_000) * 10_000
    rows = K.assign_ids(table(spark, d, "events").select(F.pmod("user_id", F.lit(1024)).alias("node"), ms.alias("ms"), "event_id"), "node", "ms", ["event_id"])
    at, node, sequence = K.decode_id(F.col("id"))
    return rows.select("event_id", "id", at.alias("at"), node.alias("node"), sequence.alias("sequence"))


def replicas(spark, d):
    """Five nodes, each a hundred entries further behind, from all writes; the first three hold what is committed."""
    w = writes(spark, d).select(F.col("seq").alias("idx"), F.floor(F.col("seq") / 5000).alias("term"), "key", "value")
    head = F.broadcast(w.agg(F.max("idx").alias("head")))  # one row
    held = w.crossJoin(head).crossJoin(F.broadcast(spark.range(5).select(F.col("id").alias("n")))).where("idx <= head - n * 100")
    return held.select(F.concat(F.lit("n"), F.col("n").cast("string")).alias("node"), "idx", "term", "key", "value", (F.col("idx") <= F.col("head") - 200).alias("committed"))


REPLICAS = f"""{WRITES}, head AS (SELECT max(seq) AS head FROM writes), replicas AS (
  SELECT 'n' || n AS node, seq AS idx, seq // 5000 AS term, key, value, seq <= head - 200 AS committed FROM writes, head, range(5) t(n) WHERE seq <= head - n * 100)"""


def quorum_commit(spark, d):
    return A.quorum_commit(replicas(spark, d).groupBy("node").agg(F.max("idx").alias("idx")))


def replication_lag(spark, d):
    return A.replication_lag(replicas(spark, d).groupBy("node").agg(F.max("idx").alias("applied")))


def ack_counts(spark, d):
    return A.ack_counts(replicas(spark, d).select("idx", "node"), A.needed_acks("quorum", 5))


def read_your_writes(spark, d):
    """Nodes that may serve sessions that wrote the entry 250 before the last."""
    at = replicas(spark, d).groupBy("node").agg(F.max("idx").alias("applied"))
    met = at.crossJoin(F.broadcast(at.agg((F.max("applied") - 250).alias("session"))))
    return met.select("node", A.may_serve("session", F.lit(False), F.col("applied"), F.col("session")).alias("ok"))


def failover_loss(spark, d):
    return A.failover_loss(replicas(spark, d), spark.createDataFrame([("n0",), ("n1",), ("n2",)], "node string"))


def log_divergence(spark, d):
    """A follower whose terms differ from entry 1234 on."""
    own = replicas(spark, d).where("node = 'n0'").select("idx", "term")
    return A.first_divergence(own, own.withColumn("term", F.col("term") + F.when(F.col("idx") >= 1234, 1).otherwise(0)))


def unsafe_terms(spark, d):
    """Leaders seen per term; one term has two."""
    seen = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("term")).distinct()
    named = seen.select("term", F.concat(F.lit("n"), F.pmod("term", F.lit(5)).cast("string")).alias("node"))
    return A.unsafe_terms(named.unionByName(named.where("term = 3").withColumn("node", F.lit("other"))))


def twopc(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("participant"), "l_returnflag", "l_linestatus")


def twopc_decide(spark, d):
    """Orders as transactions over five suppliers' groups: a return is a vote against; group s4 of orders divisible by 10 stays silent."""
    votes = twopc(spark, d).groupBy("txn", "participant").agg(F.min(F.when(F.col("l_returnflag") == "R", "abort").otherwise("commit")).alias("vote"))
    return A.decide(votes.select("txn", "participant"), votes.where("not (txn % 10 = 0 and participant = 's4')"))


def twopc_in_doubt(spark, d):
    rows = twopc(spark, d)
    prepared = rows.select("txn", "participant", F.lit("prepare").alias("action"))
    decided = rows.where("l_linestatus = 'F'").select("txn", "participant", F.lit("commit").alias("action"))
    return A.in_doubt(prepared.unionByName(decided))


def saga_trace(spark, d):
    """Orders as sagas of their lines; a return fails."""
    steps = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), (F.col("l_returnflag") != "R").alias("ok"), "l_suppkey", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("line", "name", "l_suppkey", "l_shipdate", "ok")
    return A.run_sagas(steps.select(F.col("l_orderkey").alias("saga"), F.row_number().over(order).cast("long").alias("step"), "name", "ok"))


def machine_state(spark, d):
    log = writes(spark, d).select(F.col("seq").alias("idx"), F.when(F.col("is_delete"), "delete").when(F.col("seq") % 11 == 0, "get").otherwise("put").alias("op"), "key", "value")
    return A.state_at(log, 8000)


QUERIES = {f.__name__: f for f in (vector_compare, vector_merge, siblings, anti_entropy, quorum_read, hlc_now, hlc_update, clock_rollback, snowflake_encode_decode, quorum_commit, replication_lag, ack_counts, read_your_writes, failover_loss, log_divergence, unsafe_terms, twopc_decide, twopc_in_doubt, saga_trace, machine_state)}

TEXT = "'{click:' || click || ',purchase:' || purchase || ',view:' || view || '}'"


def beats(a: str, b: str) -> str:
    return "(" + " OR ".join(f"{a}.{k} > {b}.{k}" for k in KINDS) + ")"


def relation(a: str, b: str) -> str:
    return f"CASE WHEN {beats(a, b)} AND {beats(b, a)} THEN 'concurrent' WHEN {beats(a, b)} THEN 'after' WHEN {beats(b, a)} THEN 'before' ELSE 'equal' END"


LAST = f"""{CLOCKS}, last AS (SELECT *, user_id // 10 AS key FROM clocks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"""


def siblings_sql(name: str, source: str) -> str:
    return f"""{name}u AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY key, {', '.join(KINDS)} ORDER BY event_id DESC) = 1),
{name} AS (SELECT * FROM {name}u a WHERE NOT EXISTS (SELECT 1 FROM {name}u b WHERE a.key = b.key AND {beats('b', 'a')} AND NOT {beats('a', 'b')}))"""


ORACLES = {
    "vector_compare": f"""WITH {CLOCKS}, f AS (SELECT * FROM clocks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1), l AS (SELECT * FROM clocks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT c.event_id, {relation('c', 'f')} AS first, {relation('c', 'l')} AS last FROM clocks c JOIN f ON f.user_id = c.user_id + 1 JOIN l ON l.user_id = c.user_id + 1""",
    "vector_merge": f"WITH {CLOCKS}, m AS (SELECT user_id // 10 AS grp, {', '.join(f'max({k}) AS {k}' for k in KINDS)} FROM clocks GROUP BY 1) SELECT grp, {TEXT} AS clock FROM m",
    "siblings": f"WITH {LAST}, {siblings_sql('s', 'last')} SELECT key, user_id, {TEXT} AS clock FROM s",
    "anti_entropy": f"WITH {LAST}, {siblings_sql('s', 'last')} SELECT 'n' || n AS node, key, user_id FROM s, range(3) t(n)",
    "quorum_read": f"""WITH {LAST}, prefs AS (SELECT DISTINCT key, p AS place, (key + p) % 5 AS node FROM last, range(3) t(p)),
asked AS (SELECT key, node FROM prefs WHERE node <> 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) <= 2),
held AS (SELECT l.* FROM last l JOIN asked a ON a.key = l.key AND a.node = l.user_id % 5), {siblings_sql('s', 'held')} SELECT key, user_id FROM s""",
    "hlc_now": f"""WITH {READINGS}, m AS (SELECT *, max(wall_ms) OVER (PARTITION BY node ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS physical FROM readings)
SELECT event_id, physical, row_number() OVER (PARTITION BY node, physical ORDER BY event_id) - 1 AS logical FROM m""",
    "hlc_update": f"""WITH {READINGS}, m AS (SELECT *, coalesce(lag(wall_ms) OVER w, 0) AS own, coalesce(lag(wall_ms, 2) OVER w, 0) AS remote FROM readings WINDOW w AS (PARTITION BY node ORDER BY event_id)),
t AS (SELECT *, greatest(own, remote, wall_ms) AS physical FROM m)
SELECT event_id, physical, CAST(CASE WHEN remote = physical THEN 6 WHEN own = physical THEN 4 ELSE 0 END AS BIGINT) AS logical, remote - wall_ms > 500 AS rejected FROM t""",
    "clock_rollback": f"WITH {READINGS} SELECT event_id, coalesce(wall_ms < max(wall_ms) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS back FROM readings",
    "snowflake_encode_decode": """WITH r AS (SELECT event_id, user_id % 1024 AS node, (epoch_us(ts) // 10000000) * 10000 AS ms FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY node, ms ORDER BY event_id) - 1 AS sequence FROM r)
SELECT event_id, CAST((ms - 1700000000000) * 4194304 + node * 4096 + sequence AS BIGINT) AS id, ms AS at, node, sequence FROM s""",
    "quorum_commit": f"WITH {REPLICAS}, m AS (SELECT node, max(idx) AS idx FROM replicas GROUP BY node) SELECT (SELECT count(*) FROM m) AS n, idx AS commit_idx FROM m ORDER BY idx DESC LIMIT 1 OFFSET 2",
    "replication_lag": f"WITH {REPLICAS}, m AS (SELECT node, max(idx) AS applied FROM replicas GROUP BY node) SELECT node, applied, (SELECT max(applied) FROM m) - applied AS lag FROM m",
    "ack_counts": f"WITH {REPLICAS} SELECT idx, count(DISTINCT node) AS acks, count(DISTINCT node) >= 3 AS done FROM replicas GROUP BY idx",
    "read_your_writes": f"WITH {REPLICAS} SELECT node, max(idx) >= (SELECT head FROM head) - 250 AS ok FROM replicas GROUP BY node",
    "failover_loss": f"WITH {REPLICAS} SELECT DISTINCT idx, term, key, value FROM replicas WHERE committed AND idx > (SELECT head FROM head) - 300",
    "log_divergence": "SELECT CAST(1234 AS BIGINT) AS idx",
    "unsafe_terms": "SELECT CAST(3 AS BIGINT) AS term, CAST(2 AS BIGINT) AS leaders",
    "twopc_decide": """WITH v AS (SELECT l_orderkey AS txn, l_suppkey % 5 AS p, bool_or(l_returnflag = 'R') AS no FROM lineitem GROUP BY ALL)
SELECT txn, CASE WHEN bool_or(no OR (txn % 10 = 0 AND p = 4)) THEN 'abort' ELSE 'commit' END AS decision FROM v GROUP BY txn""",
    "twopc_in_doubt": "SELECT l_orderkey AS txn, 's' || (l_suppkey % 5) AS participant FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_linestatus = 'F') = 0",
    "saga_trace": """WITH s AS (
  SELECT l_orderkey AS saga, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part-' || l_partkey, l_suppkey, l_shipdate, l_returnflag <> 'R') AS step, 'part-' || l_partkey AS name, l_returnflag <> 'R' AS ok FROM lineitem),
run AS (SELECT * FROM s WHERE step <= coalesce((SELECT min(step) FROM s f WHERE f.saga = s.saga AND NOT f.ok), step)),
last AS (SELECT saga, max(step) AS top, bool_or(NOT ok) AS failed FROM run GROUP BY saga),
acts AS (
  SELECT saga, step AS place, CASE WHEN ok THEN 'do' ELSE 'fail' END AS action, name FROM run
  UNION ALL SELECT saga, 2 * top - step + 1, 'undo', name FROM run JOIN last USING (saga) WHERE failed AND ok)
SELECT saga, CAST(row_number() OVER (PARTITION BY saga ORDER BY place) AS INTEGER) AS n, action, name FROM acts""",
    "machine_state": f"WITH {WRITES}, o AS (SELECT * FROM writes WHERE seq <= 8000 AND (is_delete OR seq % 11 <> 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, value FROM o WHERE NOT is_delete",
}
