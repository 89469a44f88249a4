"""Queries of change data capture and event sourcing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.prefix import number_rows
from millrace.operators import cdc as C
from millrace.operators import events as E
from millrace.plans.inputs import ACCOUNTS, DELTA, WRITES, account_events, writes

CUT = 6000


def changes(spark, d):
    log = C.change_log(writes(spark, d), "key", "value", ["seq"])
    return number_rows(log, F.floor(F.col("seq") / 10_000), ["seq"], "lsn", 1).select("lsn", F.lit("orders").alias("tbl"), "op", "pk", "before", "after")


CHANGES = f"""{WRITES},
moved AS (
  SELECT seq, key AS pk, lag(CASE WHEN NOT is_delete THEN value END) OVER w AS before, CASE WHEN NOT is_delete THEN value END AS after,
         coalesce(lag(NOT is_delete) OVER w, FALSE) AS was, NOT is_delete AS is_
  FROM writes WINDOW w AS (PARTITION BY key ORDER BY seq)),
changes AS (
  SELECT row_number() OVER (ORDER BY seq) AS lsn, 'orders' AS tbl, CASE WHEN was AND is_ THEN 'update' WHEN is_ THEN 'insert' ELSE 'delete' END AS op, pk, before, after
  FROM moved WHERE was OR is_),
final AS (SELECT pk, after AS value, lsn FROM changes QUALIFY row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) = 1 AND op <> 'delete'),
early AS (SELECT pk, after AS value, lsn FROM (SELECT * FROM changes WHERE lsn <= {CUT}) QUALIFY row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) = 1 AND op <> 'delete')"""


def cdc_changes(spark, d):
    return changes(spark, d)


def cdc_tail(spark, d):
    return C.changes_since(changes(spark, d), CUT, "orders").select("lsn", "op", "pk")


def cdc_apply(spark, d):
    """Changes that come twice and in any order."""
    log = changes(spark, d)
    return C.apply_changes(log.unionByName(log))


def cdc_snapshot(spark, d):
    return C.take_snapshot(changes(spark, d), CUT).select("lsn", "pk", "after")


def cdc_bootstrap_tail(spark, d):
    return C.bootstrap_and_tail(changes(spark, d), CUT).select("pk", "value")


def cdc_diff(spark, d):
    """What a copy that stopped at the cut lacks, has too much of, or has wrong."""
    log = changes(spark, d)
    return C.reconcile(C.apply_changes(log), C.apply_changes(log.where(F.col("lsn") <= CUT)))


def cdc_schema_evolution(spark, d):
    """Rows before and after a column was added, in the new schema: old rows have the default, new ones their own."""
    w = writes(spark, d)
    old = w.where("seq <= 7000").select(F.col("seq").alias("pk"), "value")
    new = w.where("seq > 7000").select(F.col("seq").alias("pk"), F.when(F.col("seq") % 2 == 0, "own").alias("channel"), "value")
    return C.add_column(C.union_versions(old, new, {}), "channel", "string", "web").select("pk", "value", "channel")


def es_replay(spark, d):
    return E.replay(account_events(spark, d))


def es_projection(spark, d):
    return E.project(account_events(spark, d))


def es_catch_up(spark, d):
    """A projection up to a position, brought up to date."""
    events = account_events(spark, d)
    return E.catch_up(E.project(events.where("global_pos <= 4000")), events, 4000)


def es_running_balance(spark, d):
    return E.running_balance(account_events(spark, d)).select("stream", "version", "balance")


def es_snapshot_tail(spark, d):
    events = account_events(spark, d)
    return E.snapshot_and_tail(E.replay(events.where("version <= 20")), events)


def es_cas_audit(spark, d):
    """Appends that expect the version of every other event before theirs."""
    attempts = account_events(spark, d).select("stream", "global_pos", (F.floor(F.col("version") / 2) * 2).alias("expected"))
    return E.audit_appends(attempts, ["global_pos"]).select("global_pos", "expected", "found", "conflict")


def es_rules(spark, d):
    return E.judge_commands(account_events(spark, d)).select("stream", "version", "before", "allowed")


def es_log_tail(spark, d):
    return E.load_from(account_events(spark, d), 1234, 50).select("global_pos", "stream", "type")


def es_stream(spark, d):
    return E.load_stream(account_events(spark, d), 17).select("version", "type", "amount")


QUERIES = {f.__name__: f for f in (cdc_changes, cdc_tail, cdc_apply, cdc_snapshot, cdc_bootstrap_tail, cdc_diff, cdc_schema_evolution, es_replay, es_projection, es_catch_up, es_running_balance, es_snapshot_tail, es_cas_audit, es_rules, es_log_tail, es_stream)}

REPLAY = f"SELECT stream, CAST(sum({DELTA}) AS BIGINT) AS balance, max(version) AS version, bool_or(type = 'Closed') AS closed FROM accounts GROUP BY stream"
PROJECT = f"""resets AS (SELECT stream, max(global_pos) FILTER (type IN ('Opened', 'Closed')) AS reset, arg_max(type, global_pos) FILTER (type IN ('Opened', 'Closed')) AS by_ FROM accounts GROUP BY stream),
later AS (SELECT stream, sum({DELTA}) AS moved, count(*) AS n FROM accounts JOIN resets USING (stream) WHERE type IN ('Deposited', 'Withdrawn') AND (reset IS NULL OR global_pos > reset) GROUP BY stream)
SELECT stream, CAST(coalesce(moved, 0) AS BIGINT) AS balance FROM resets LEFT JOIN later USING (stream) WHERE by_ IS NULL OR by_ <> 'Closed' OR n > 0"""
ORACLES = {
    "cdc_changes": f"WITH {CHANGES} SELECT * FROM changes",
    "cdc_tail": f"WITH {CHANGES} SELECT lsn, op, pk FROM changes WHERE lsn > {CUT}",
    "cdc_apply": f"WITH {CHANGES} SELECT * FROM final",
    "cdc_snapshot": f"WITH {CHANGES} SELECT CAST({CUT} AS BIGINT) AS lsn, pk, value AS after FROM early",
    "cdc_bootstrap_tail": f"WITH {CHANGES} SELECT pk, value FROM final",
    "cdc_diff": f"""WITH {CHANGES} SELECT pk, CASE WHEN e.pk IS NULL THEN 'missing' WHEN f.pk IS NULL THEN 'extra' ELSE 'unequal' END AS kind, CAST(f.value AS VARCHAR) AS source, CAST(e.value AS VARCHAR) AS copy
FROM final f FULL JOIN early e USING (pk) WHERE f.value IS DISTINCT FROM e.value""",
    "cdc_schema_evolution": f"WITH {WRITES} SELECT seq AS pk, value, CASE WHEN seq > 7000 AND seq % 2 = 0 THEN 'own' ELSE 'web' END AS channel FROM writes",
    "es_replay": f"WITH {ACCOUNTS} {REPLAY}",
    "es_projection": f"WITH {ACCOUNTS}, {PROJECT}",
    "es_catch_up": f"WITH {ACCOUNTS}, {PROJECT}",
    "es_running_balance": f"WITH {ACCOUNTS} SELECT stream, version, CAST(sum({DELTA}) OVER (PARTITION BY stream ORDER BY version ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM accounts",
    "es_snapshot_tail": f"WITH {ACCOUNTS} {REPLAY}",
    "es_cas_audit": f"WITH {ACCOUNTS} SELECT global_pos, (version // 2) * 2 AS expected, version - 1 AS found, (version // 2) * 2 <> version - 1 AS conflict FROM accounts",
    "es_rules": f"""WITH {ACCOUNTS}, s AS (
  SELECT *, CAST(coalesce(sum({DELTA}) OVER w, 0) AS BIGINT) AS before, coalesce(bool_or(type = 'Closed') OVER w, FALSE) AS was_closed
  FROM accounts WINDOW w AS (PARTITION BY stream ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream, version, before, NOT was_closed AND CASE type WHEN 'Deposited' THEN amount > 0 WHEN 'Withdrawn' THEN amount > 0 AND before >= amount WHEN 'Closed' THEN before = 0 ELSE TRUE END AS allowed FROM s""",
    "es_log_tail": f"WITH {ACCOUNTS} SELECT global_pos, stream, type FROM accounts WHERE global_pos > 1234 ORDER BY global_pos LIMIT 50",
    "es_stream": f"WITH {ACCOUNTS} SELECT version, type, amount FROM accounts WHERE stream = 17",
}
