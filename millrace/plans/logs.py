"""Queries of the partitioned log."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.hashing import fnv1a32
from millrace.operators import log as L
from millrace.plans.inputs import LOG, log_records
from millrace.sources.tables import table


def log(spark, d):
    return L.append(log_records(spark, d), "partition", ["event_id"])


def log_offsets(spark, d):
    return log(spark, d).select("partition", "offset", "segment_id", "key", "value")


def log_append_more(spark, d):
    """The later half appended to the earlier: offsets go on."""
    rows = log_records(spark, d)
    first = L.append(rows.where("event_id % 2 = 0"), "partition", ["event_id"])
    heads = L.watermarks(first, "partition").select("partition", F.col("high_watermark").alias("next_offset"))
    return L.append(rows.where("event_id % 2 = 1"), "partition", ["event_id"], heads).select("partition", "event_id", "offset")


def log_read(spark, d):
    return L.read(log(spark, d), "partition", 1, 150, 40).select("partition", "offset", "key", "value")


def log_watermarks(spark, d):
    return L.watermarks(log(spark, d), "partition")


def log_retention(spark, d):
    return L.truncate_before(log(spark, d), "partition", 250).select("partition", "offset")


def log_partitions(spark, d):
    """Keys to partitions by FNV-1a; rows without a key (clicks here) take turns."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("user_id").cast("string")).alias("key"))
    return rows.select("event_id", L.partition_for(F.col("key"), 6, F.col("event_id")).alias("partition"))


def fnv_hashes(spark, d):
    return table(spark, d, "nation").select("n_name", fnv1a32(F.col("n_name")).alias("h"))


def group_assignment(spark, d):
    """Six partitions over one, two and three members."""
    parts = spark.range(6).select(F.col("id").cast("int").alias("partition"))
    out = None
    for m in (1, 2, 3):
        members = spark.range(m).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.col("id").alias("joined"))
        dealt = L.assignment(parts, members).select(F.lit(m).alias("members"), "partition", "member")
        out = dealt if out is None else out.union(dealt)
    return out


def committed(spark, d):
    """Offsets committed after the first half of each partition."""
    return L.watermarks(log(spark, d), "partition").select("partition", F.floor(F.col("high_watermark") / 2).alias("next_offset"))


def consumer_poll(spark, d):
    return L.poll(log(spark, d), "partition", committed(spark, d), 25).select("partition", "offset", "value")


def consumer_commit(spark, d):
    polled = L.poll(log(spark, d), "partition", committed(spark, d), 25)
    return L.commit(committed(spark, d), polled, "partition")


def consumer_lag(spark, d):
    return L.group_lag(log(spark, d), "partition", committed(spark, d))


def consumer_resets(spark, d):
    """After retention partitions whose committed offset is gone go on at the log's start."""
    return L.resets(L.truncate_before(log(spark, d), "partition", 2000), "partition", committed(spark, d))


QUERIES = {f.__name__: f for f in (log_offsets, log_append_more, log_read, log_watermarks, log_retention, log_partitions, fnv_hashes, group_assignment, consumer_poll, consumer_commit, consumer_lag, consumer_resets)}


def fnv_sql(c: str) -> str:
    """FNV-1a over an ASCII text; the product stays below 2^63."""
    return f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({c}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


COMMITTED = """marks AS (SELECT partition, min("offset") AS log_start, max("offset") + 1 AS high_watermark FROM seg GROUP BY partition),
done AS (SELECT partition, high_watermark // 2 AS next_offset FROM marks),
polled AS (SELECT s.* FROM seg s JOIN done USING (partition) WHERE "offset" >= next_offset AND "offset" < next_offset + 25)"""
KEPT = """kept AS (SELECT * FROM seg JOIN (SELECT partition, segment_id, max("offset") AS last FROM seg GROUP BY ALL) USING (partition, segment_id) WHERE last >= {cut})"""
ORACLES = {
    "log_offsets": f'WITH {LOG} SELECT partition, "offset", segment_id, key, value FROM seg',
    "log_append_more": """WITH a AS (SELECT CAST(user_id % 3 AS INTEGER) AS partition, count(*) AS head FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT CAST(user_id % 3 AS INTEGER) AS partition, event_id, coalesce(head, 0) + row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS "offset"
FROM events LEFT JOIN a ON a.partition = user_id % 3 WHERE event_id % 2 = 1""",
    "log_read": f'WITH {LOG} SELECT partition, "offset", key, value FROM seg WHERE partition = 1 AND "offset" >= 150 AND "offset" < 190',
    "log_watermarks": f"WITH {LOG}, {COMMITTED} SELECT * FROM marks",
    "log_retention": f'WITH {LOG}, {KEPT.format(cut=250)} SELECT partition, "offset" FROM kept',
    "log_partitions": f"SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN event_id % 6 ELSE {fnv_sql('CAST(user_id AS VARCHAR)')} % 6 END AS INTEGER) AS partition FROM events",
    "fnv_hashes": f"SELECT n_name, {fnv_sql('n_name')} AS h FROM nation",
    "group_assignment": "SELECT CAST(m AS INTEGER) AS members, CAST(p AS INTEGER) AS partition, 'm' || (p % m) AS member FROM range(6) a(p), range(1, 4) b(m)",
    "consumer_poll": f'WITH {LOG}, {COMMITTED} SELECT partition, "offset", value FROM polled',
    "consumer_commit": f'WITH {LOG}, {COMMITTED} SELECT partition, coalesce((SELECT max("offset") + 1 FROM polled p WHERE p.partition = d.partition), next_offset) AS next_offset FROM done d',
    "consumer_lag": f"WITH {LOG}, {COMMITTED} SELECT partition, next_offset, high_watermark, high_watermark - next_offset AS lag FROM marks JOIN done USING (partition)",
    "consumer_resets": f'WITH {LOG}, {COMMITTED}, {KEPT.format(cut=2000)} SELECT partition, start AS next_offset FROM (SELECT partition, min("offset") AS start FROM kept GROUP BY partition) JOIN done USING (partition) WHERE next_offset < start',
}
