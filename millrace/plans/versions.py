"""Queries of versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import versioned as V
from millrace.plans.inputs import HISTORY, WRITES, history, writes

READ_TS, FRESH = 5000, 9000


def lww_latest(spark, d):
    return V.latest(writes(spark, d), "key", ["seq"])


def lww_live_keys(spark, d):
    return V.live(writes(spark, d), "key", ["seq"]).select("key")


def lww_compaction(spark, d):
    return V.compact(writes(spark, d), "key", ["seq"])


def lww_compaction_middle(spark, d):
    """Below the last level tombstones stay."""
    return V.compact(writes(spark, d), "key", ["seq"], last_level=False)


def lww_get(spark, d):
    return V.get(writes(spark, d), "key", ["seq"], 100).unionByName(V.get(writes(spark, d), "key", ["seq"], 7))


def ordered_range_scan(spark, d):
    return V.seek(V.live(writes(spark, d), "key", ["seq"]), "key", 250, 10).select("key", "value")


def merged_sources(spark, d):
    """Three runs of writes, newest first, merged with shadowing."""
    w = writes(spark, d)
    runs = [V.latest(w.where(F.pmod("seq", F.lit(3)) == i), "key", ["seq"]) for i in (2, 1, 0)]
    return V.merge_sources(runs, "key").select("key", "seq", "value")


def level_policy(spark, d):
    """Levels due for compaction, from a manifest made of the writes."""
    tables = writes(spark, d).groupBy(F.pmod("key", F.lit(40)).alias("t")).agg((F.count(F.lit(1)) * 100).alias("bytes")).select(F.pmod("t", F.lit(4)).alias("level"), "bytes")
    return V.level_budgets(tables, 50_000, 4)


def overlapping_tables(spark, d):
    """Tables of one level whose key range meets a table of the next."""
    w = writes(spark, d)
    ranges = lambda n: w.groupBy(F.pmod("seq", F.lit(n)).alias("table")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    cut = ranges(50).withColumn("low", F.col("low") + F.col("table") * 20).withColumn("high", F.col("low") + 30)
    return V.overlapping(cut, cut).where("a < b")


def mvcc_versions(spark, d):
    return history(spark, d)


def mvcc_snapshot(spark, d):
    return V.snapshot(history(spark, d), READ_TS).select("key", "value", "start_ts")


def mvcc_own_writes(spark, d):
    """A snapshot under a transaction's own writes: keys up to 20, of which even ones are deleted."""
    snap = V.snapshot(history(spark, d), READ_TS).select("key", "value")
    own = spark.range(21).select(F.col("id").alias("key"), F.lit(-1).cast("bigint").alias("value"), (F.col("id") % 2 == 0).alias("deleted"))
    return V.overlay(snap, own, "key")


def mvcc_history(spark, d):
    return V.history_text(history(spark, d), "key", "value")


def mvcc_gc(spark, d):
    return V.collect_garbage(history(spark, d), FRESH).select("key", "start_ts")


def mvcc_stats(spark, d):
    return V.version_stats(history(spark, d), "key")


def txns(spark, d):
    """Transactions of three writes each, begun five ticks before the first: they write those keys and read the next."""
    w = writes(spark, d)
    of = w.select(F.floor((F.col("seq") - 1) / 3).alias("txn"), F.col("key"), "seq")
    spans = of.groupBy("txn").agg((F.min("seq") - 5).alias("read_ts"), F.max("seq").alias("commit_ts"))
    return of.select("txn", F.pmod("key", F.lit(97)).alias("key")).distinct(), spans


TXNS = f"""WITH {WRITES},
of_ AS (SELECT (seq - 1) // 3 AS txn, key % 97 AS key, seq FROM writes),
spans AS (SELECT txn, min(seq) - 5 AS read_ts, max(seq) AS commit_ts FROM of_ GROUP BY txn),
w AS (SELECT DISTINCT txn, key FROM of_), r AS (SELECT DISTINCT txn, (key + 1) % 97 AS key FROM of_)"""


def mvcc_conflicts(spark, d):
    touched, spans = txns(spark, d)
    versions = history(spark, d).select(F.pmod("key", F.lit(97)).alias("key"), "start_ts")
    rows = touched.join(spans, "txn")
    own = rows.select("txn", "read_ts", F.col("commit_ts") - 2, "key").toDF("txn", "read_ts", "commit_ts", "key")
    return V.conflicts(own, versions, "key").select("txn", "key")


def mvcc_write_skew(spark, d):
    touched, spans = txns(spark, d)
    reads = touched.select("txn", F.pmod(F.col("key") + 1, F.lit(97)).alias("key")).distinct()
    return V.write_skew(spans, reads, touched)


QUERIES = {f.__name__: f for f in (lww_latest, lww_live_keys, lww_compaction, lww_compaction_middle, lww_get, ordered_range_scan, merged_sources, level_policy, overlapping_tables, mvcc_versions, mvcc_snapshot, mvcc_own_writes, mvcc_history, mvcc_gc, mvcc_stats, mvcc_conflicts, mvcc_write_skew)}

LAST = f"WITH {WRITES}, last AS (SELECT * FROM writes QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) "
ORACLES = {
    "lww_latest": LAST + "SELECT key, seq, value, is_delete FROM last",
    "lww_live_keys": LAST + "SELECT key FROM last WHERE NOT is_delete",
    "lww_compaction": LAST + "SELECT key, seq, value, is_delete FROM last WHERE NOT is_delete",
    "lww_compaction_middle": LAST + "SELECT key, seq, value, is_delete FROM last",
    "lww_get": LAST + "SELECT key, seq, value, is_delete FROM last WHERE NOT is_delete AND key IN (100, 7)",
    "ordered_range_scan": LAST + "SELECT key, value FROM last WHERE NOT is_delete AND key >= 250 ORDER BY key LIMIT 10",
    "merged_sources": f"WITH {WRITES}, runs AS (SELECT *, CASE seq % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM writes) SELECT key, seq, value FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, seq DESC) = 1",
    "level_policy": f"""WITH {WRITES}, t AS (SELECT key % 40 AS t, count(*) * 100 AS bytes FROM writes GROUP BY 1), l AS (SELECT t % 4 AS level, count(*) AS tables, CAST(sum(bytes) AS BIGINT) AS bytes FROM t GROUP BY 1)
SELECT *, CASE WHEN level = 0 THEN tables >= 4 ELSE bytes > 50000 * pow(4, level - 1) END AS compact FROM l""",
    "overlapping_tables": f"""WITH {WRITES}, t AS (SELECT seq % 50 AS tbl, min(key) + (seq % 50) * 20 AS low FROM writes GROUP BY seq % 50)
SELECT a.tbl AS a, b.tbl AS b FROM t a JOIN t b ON a.low <= b.low + 30 AND a.low + 30 >= b.low WHERE a.tbl < b.tbl""",
    "mvcc_versions": f"WITH {HISTORY} SELECT * FROM history",
    "mvcc_snapshot": f"WITH {HISTORY} SELECT key, value, start_ts FROM history WHERE start_ts <= {READ_TS} AND (end_ts = 0 OR end_ts > {READ_TS}) AND NOT deleted",
    "mvcc_own_writes": f"WITH {HISTORY} SELECT key, value FROM history WHERE start_ts <= {READ_TS} AND (end_ts = 0 OR end_ts > {READ_TS}) AND NOT deleted AND key > 20 UNION ALL SELECT i, -1 FROM range(21) t(i) WHERE i % 2 = 1",
    "mvcc_history": f"WITH {HISTORY} SELECT key, count(*) AS versions, string_agg(start_ts || '..' || end_ts || '=' || CASE WHEN deleted THEN 'del' ELSE CAST(value AS VARCHAR) END, ' ' ORDER BY start_ts) AS chain FROM history GROUP BY key",
    "mvcc_gc": f"WITH {HISTORY} SELECT key, start_ts FROM history WHERE end_ts = 0 OR end_ts > {FRESH}",
    "mvcc_stats": f"WITH {HISTORY} SELECT count(DISTINCT key) AS keys, count(*) AS versions, count(*) FILTER (end_ts = 0 AND NOT deleted) AS live FROM history",
    "mvcc_conflicts": f"{TXNS} SELECT w.txn, w.key FROM w JOIN spans s USING (txn) WHERE EXISTS (SELECT 1 FROM writes v WHERE v.key % 97 = w.key AND v.seq > s.read_ts AND v.seq < s.commit_ts - 2)",
    "mvcc_write_skew": f"""{TXNS}, met AS (SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM r JOIN w USING (key) JOIN spans p ON p.txn = r.txn JOIN spans q ON q.txn = w.txn
  WHERE r.txn <> w.txn AND p.read_ts < q.commit_ts AND q.read_ts < p.commit_ts),
common AS (SELECT DISTINCT m.txn AS a, n.txn AS b FROM w m JOIN w n USING (key) WHERE m.txn < n.txn)
SELECT x.reader AS a, x.writer AS b FROM met x JOIN met y ON x.reader = y.writer AND x.writer = y.reader LEFT JOIN common c ON c.a = x.reader AND c.b = x.writer WHERE x.reader < x.writer AND c.a IS NULL""",
}
