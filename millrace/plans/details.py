"""Queries of column functions: rendering, lenient numbers, patches, clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import causal as K
from millrace.operators import cdc as C
from millrace.operators import events as E
from millrace.plans.causality import CLOCKS, TEXT, clocks
from millrace.plans.inputs import ACCOUNTS, account_events
from millrace.sources.tables import table


def event_rendering(spark, d):
    data = F.create_map(F.lit("type"), F.col("type"), F.lit("amount"), F.col("amount").cast("string"))
    return account_events(spark, d).select("global_pos", E.describe(F.col("stream"), F.col("version"), F.col("type"), data).alias("line"))


def lenient_ints(spark, d):
    return table(spark, d, "events").select("event_id", E.lenient_int(F.col("value").cast("double") - 50.5, "double").alias("whole"))


def clock_bump(spark, d):
    return clocks(spark, d).select("event_id", K.format_clock(K.bump(F.col("clock"), "view")).alias("clock"))


def hlc_order(spark, d):
    a = F.struct(F.pmod("event_id", F.lit(7)).alias("physical"), F.pmod("user_id", F.lit(5)).alias("logical"))
    b = F.struct(F.pmod("user_id", F.lit(7)).alias("physical"), F.pmod("event_id", F.lit(5)).alias("logical"))
    return table(spark, d, "events").select("event_id", K.hlc_compare(a, b).alias("found"))


def row_patch(spark, d):
    """Orders as rows of two fields; every other one gets a patch of one of them, the others a field more."""
    before = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    change = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("X"))).otherwise(F.create_map(F.lit("note"), F.col("o_orderkey").cast("string")))
    after = F.array_sort(F.map_entries(C.patch(before, C.reject_rekeying(change, before, "priority"))))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(after, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("fields"))


QUERIES = {f.__name__: f for f in (event_rendering, lenient_ints, clock_bump, hlc_order, row_patch)}

ORACLES = {
    "event_rendering": f"WITH {ACCOUNTS} SELECT global_pos, stream || '@' || version || ' ' || type || '{{amount=' || amount || ' type=' || type || '}}' AS line FROM accounts",
    "lenient_ints": "SELECT event_id, coalesce(CAST(trunc(CAST(value AS DOUBLE) - 50.5) AS BIGINT), 0) AS whole FROM events",
    "clock_bump": f"WITH {CLOCKS}, m AS (SELECT event_id, click, purchase, view + 1 AS view FROM clocks) SELECT event_id, {TEXT} AS clock FROM m",
    "hlc_order": """SELECT event_id, CAST(CASE WHEN event_id % 7 <> user_id % 7 THEN sign(event_id % 7 - user_id % 7) ELSE sign(user_id % 5 - event_id % 5) END AS INTEGER) AS found FROM events""",
    "row_patch": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'priority=' || o_orderpriority || ' status=X'
  ELSE 'note=' || o_orderkey || ' priority=' || o_orderpriority || ' status=' || o_orderstatus END AS fields FROM orders""",
}
