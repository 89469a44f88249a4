"""Inputs that queries derive from the tables: writes, change logs, events, arrivals. Their SQL twins are the CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.prefix import number_rows
from millrace.sources.tables import table


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as writes: key customer, value price in cents, a delete where the status is F, numbered by date and key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), cents("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("is_delete"), "o_orderdate", "o_orderkey")
    return number_rows(orders, F.date_format("o_orderdate", "yyyyMM"), ["o_orderdate", "o_orderkey"], "seq", 1).select("key", "value", "is_delete", "seq")


WRITES = """writes AS (
  SELECT o_custkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderstatus = 'F' AS is_delete,
         row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq
  FROM orders)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes as versions: start_ts is the write's number, end_ts the start of the key's next version."""
    end = F.coalesce(F.lead("seq").over(Window.partitionBy("key").orderBy("seq")), F.lit(0).cast("long"))
    return writes(spark, sf_dir).select("key", "value", F.col("seq").alias("start_ts"), end.alias("end_ts"), F.col("is_delete").alias("deleted"))


HISTORY = f"""{WRITES},
history AS (
  SELECT key, value, seq AS start_ts, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), 0) AS end_ts, is_delete AS deleted FROM writes)"""


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as account events of users; versions and positions by event id."""
    kind = F.create_map(*[F.lit(x) for p in (("signup", "Opened"), ("purchase", "Deposited"), ("error", "Withdrawn"), ("view", "Closed")) for x in p])
    rows = table(spark, sf_dir, "events").where("event_type <> 'click'").select(F.col("user_id").alias("stream"), F.try_element_at(kind, F.col("event_type")).alias("type"), cents("value").alias("amount"), "event_id")
    numbered = number_rows(rows, F.floor(F.col("event_id") / 100_000), ["event_id"], "global_pos", 1)
    return numbered.select("stream", F.row_number().over(Window.partitionBy("stream").orderBy("event_id")).cast("long").alias("version"), "global_pos", "type", "amount")


ACCOUNTS = """accounts AS (
  SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, row_number() OVER (ORDER BY event_id) AS global_pos,
         CASE event_type WHEN 'signup' THEN 'Opened' WHEN 'purchase' THEN 'Deposited' WHEN 'error' THEN 'Withdrawn' WHEN 'view' THEN 'Closed' END AS type,
         CAST(round(value * 100) AS BIGINT) AS amount
  FROM events WHERE event_type <> 'click')"""

DELTA = "CASE type WHEN 'Deposited' THEN amount WHEN 'Withdrawn' THEN -amount ELSE 0 END"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in an order of arrival that lags event time by up to six hours."""
    late = F.make_dt_interval(mins=F.pmod(F.col("event_id") * 7919, F.lit(361)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("key"), cents("value").alias("value"), (F.col("ts") + late).alias("arrival"))


ARRIVALS = """arrivals AS (
  SELECT event_id, ts, event_type AS key, CAST(round(value * 100) AS BIGINT) AS value, ts + to_minutes(CAST((event_id * 7919) % 361 AS INTEGER)) AS arrival FROM events)"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records in three partitions."""
    return table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(3)).cast("int").alias("partition"), "event_id", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "ts")


LOG = """log AS (
  SELECT CAST(user_id % 3 AS INTEGER) AS partition, event_id, CAST(user_id AS VARCHAR) AS key, event_type AS value,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS "offset"
  FROM events),
seg AS (SELECT *, ("offset" // 100) * 100 AS segment_id FROM log)"""
