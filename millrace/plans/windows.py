"""Queries of event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import windowing as W
from millrace.plans.inputs import ARRIVALS, arrivals, cents
from millrace.session import checkpoint_dir
from millrace.sources.tables import table
from millrace.streaming.native import KeyedSink, run_to_end, window_stream

HOUR = 3600
ORDER = ["arrival", "event_id"]


def tumbling_agg(spark, d):
    return W.window_sums(table(spark, d, "events"), "ts", "event_type", cents("value"), HOUR)


def sliding_agg(spark, d):
    return W.window_sums(table(spark, d, "events"), "ts", "event_type", cents("value"), HOUR, HOUR // 4)


def gapped_agg(spark, d):
    """A slide over the size: times in the gaps are in no window."""
    return W.window_sums(table(spark, d, "events"), "ts", "event_type", cents("value"), HOUR, 2 * HOUR)


def weekly_go_aligned(spark, d):
    """Weeks begin on Mondays, as counted from the first of January of year 1."""
    return W.window_sums(table(spark, d, "events"), "ts", "event_type", cents("value"), 7 * 24 * HOUR)


def fated(spark, d, size=HOUR, slide=None):
    return W.exact_windows(arrivals(spark, d), "ts", "key", "value", ORDER, W.hour_of(F.col("arrival")), size, HOUR, 2 * HOUR, slide)


def shown(frame):
    return frame.withColumns({c: W.from_micros(F.col(c)) for c in ("window_start", "window_end")})


def window_revisions(spark, d):
    return shown(W.emissions(fated(spark, d), ORDER))


def sliding_revisions(spark, d):
    return shown(W.emissions(fated(spark, d, HOUR, HOUR // 4), ORDER))


def window_late(spark, d):
    return shown(W.side_output(fated(spark, d), ORDER)).drop("arrival")


def sliding_late(spark, d):
    return shown(W.side_output(fated(spark, d, HOUR, HOUR // 4), ORDER)).drop("arrival")


def window_sink(spark, d):
    return shown(W.latest_panes(W.emissions(fated(spark, d), ORDER)))


def sink_counters(spark, d):
    """Physical writes and logical keys of the sink."""
    return W.latest_panes(W.emissions(fated(spark, d), ORDER)).agg(F.sum("writes").alias("attempts"), F.count(F.lit(1)).alias("logical"))


def watermark_trace(spark, d):
    marked = W.watermarks(arrivals(spark, d), "ts", ORDER, HOUR, W.hour_of(F.col("arrival")))
    return marked.select("event_id", W.from_micros(F.col("wm")).alias("watermark"))


def streamed(spark, d, slide=None):
    """The same sums by a stream over the table's file, through the keyed sink, in as many batches as it takes."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    sink = KeyedSink(spark, f"{folder}/sink", ["window_start", "window_end", "key"])
    run_to_end(window_stream(events, "ts", "event_type", cents("value"), HOUR, HOUR, slide), sink, f"{folder}/checkpoint")
    held = sink.read()
    return held if held is not None else W.window_sums(table(spark, d, "events").limit(0), "ts", "event_type", cents("value"), HOUR)


def stream_tumbling(spark, d):
    return streamed(spark, d)


def stream_sliding(spark, d):
    return streamed(spark, d, HOUR // 4)


QUERIES = {f.__name__: f for f in (tumbling_agg, sliding_agg, gapped_agg, weekly_go_aligned, window_revisions, sliding_revisions, window_late, sliding_late, window_sink, sink_counters, watermark_trace, stream_tumbling, stream_sliding)}


def sums_sql(size: str, slide: str, steps: int) -> str:
    return f"""SELECT w AS window_start, w + INTERVAL {size} AS window_end, event_type AS key, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n
FROM (SELECT *, time_bucket(INTERVAL {slide}, ts) - k * INTERVAL {slide} AS w FROM events, range({steps}) t(k)) WHERE ts < w + INTERVAL {size} GROUP BY ALL"""


def fated_sql(slide: str, steps: int) -> str:
    return f"""WITH {ARRIVALS},
marked AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 1 HOUR AS wm FROM arrivals),
placed AS (SELECT *, time_bucket(INTERVAL {slide}, ts) - k * INTERVAL {slide} AS window_start FROM marked, range({steps}) t(k)),
fated AS (
  SELECT *, window_start + INTERVAL 1 HOUR AS window_end,
         CASE WHEN wm > window_start + INTERVAL 3 HOUR THEN 'too_late' WHEN wm > window_start + INTERVAL 1 HOUR THEN 'tardy' ELSE 'on_time' END AS fate
  FROM placed WHERE ts < window_start + INTERVAL 1 HOUR),
first_ AS (SELECT window_start, window_end, key, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM fated WHERE fate = 'on_time' GROUP BY ALL),
tardy AS (
  SELECT window_start, window_end, key, count(*) OVER w AS k, CAST(sum(value) OVER w AS BIGINT) AS more FROM fated WHERE fate = 'tardy'
  WINDOW w AS (PARTITION BY window_start, window_end, key ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)),
emitted AS (
  SELECT window_start, window_end, key, 1 AS revision, total, n FROM first_ WHERE window_end < (SELECT max(wm) FROM marked)
  UNION ALL
  SELECT t.window_start, t.window_end, t.key, t.k + CASE WHEN f.n IS NULL THEN 0 ELSE 1 END, coalesce(f.total, 0) + t.more, coalesce(f.n, 0) + t.k
  FROM tardy t LEFT JOIN first_ f ON (t.window_start, t.window_end, t.key) = (f.window_start, f.window_end, f.key)),
panes AS (SELECT window_start, window_end, key, max_by(total, revision) AS total, max_by(n, revision) AS n, count(*) AS writes FROM emitted GROUP BY ALL)
"""


EMITTED = "SELECT window_start, window_end, key, revision, total, n FROM emitted"
LATE = "SELECT event_id, key, value, window_start, window_end FROM fated WHERE fate = 'too_late'"
ORACLES = {
    "tumbling_agg": sums_sql("1 HOUR", "1 HOUR", 1),
    "sliding_agg": sums_sql("1 HOUR", "15 MINUTE", 4),
    "stream_tumbling": sums_sql("1 HOUR", "1 HOUR", 1),
    "stream_sliding": sums_sql("1 HOUR", "15 MINUTE", 4),
    "gapped_agg": sums_sql("1 HOUR", "2 HOUR", 1),
    "weekly_go_aligned": sums_sql("7 DAY", "7 DAY", 1),
    "window_revisions": fated_sql("1 HOUR", 1) + EMITTED,
    "sliding_revisions": fated_sql("15 MINUTE", 4) + EMITTED,
    "window_late": fated_sql("1 HOUR", 1) + LATE,
    "sliding_late": fated_sql("15 MINUTE", 4) + LATE,
    "window_sink": fated_sql("1 HOUR", 1) + "SELECT * FROM panes",
    "sink_counters": fated_sql("1 HOUR", 1) + "SELECT CAST(sum(writes) AS BIGINT) AS attempts, count(*) AS logical FROM panes",
    "watermark_trace": fated_sql("1 HOUR", 1) + "SELECT event_id, wm AS watermark FROM marked",
}
