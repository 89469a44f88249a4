"""Event-time windows with watermarks, allowed lateness, revisions and a side output, exact over a batch.

Each event moves the watermark (the largest event time so far less a bound) before its own lateness is judged. A pane
(window, key) is emitted once the watermark is past the window's end, and again, as the next revision, for each event
that comes after that but within the allowed lateness; later events go to the side output, once per expired window.
The whole history has a closed form over a total arrival order, so it runs as joins, windows and sums. Times are
TIMESTAMP_NTZ; arithmetic is in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.prefix import running_max

SECOND = 1_000_000
#: Seconds from the first of January of year 1 to 1970; windows are aligned to the former.
YEAR_ONE = 62_135_596_800
MOST_WINDOWS = 1025


def micros(ts: Column) -> Column:
    """Microseconds from 1970 to a TIMESTAMP_NTZ, whatever the session's time zone."""
    ts = ts.cast("timestamp_ntz")
    minutes = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * (60 * SECOND) + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def from_micros(us: Column) -> Column:
    seconds = (us.cast("decimal(20,0)") / SECOND).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def hour_of(ts: Column) -> Column:
    """Hours from 1970: a bucket that ascends with time."""
    return F.floor(micros(ts) / (3600 * SECOND))


def truncate(us: Column, size: int) -> Column:
    """The latest multiple of `size` microseconds, counted from year 1, that isn't after `us`."""
    origin = (-YEAR_ONE * SECOND) % size
    return us - F.pmod(us - F.lit(origin), F.lit(size))


def window_starts(us: Column, size: int, slide: int | None = None) -> Column:
    """Starts of all windows that hold a time, latest first. No slide: tumbling. A slide over the size leaves gaps."""
    slide = slide if slide and slide > 0 else size
    last = truncate(us, slide)
    count = F.floor((last - us + size - 1) / slide).cast("int") + 1  # starts after us - size
    count = F.least(count, F.lit(MOST_WINDOWS))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: last - k.cast("long") * slide)).otherwise(F.array().cast("array<bigint>"))


def assign_windows(events: DataFrame, time_col: str, size_s: int, slide_s: int | None = None) -> DataFrame:
    """One row per event and window, with window_start and window_end (half open)."""
    size, slide = size_s * SECOND, slide_s and slide_s * SECOND
    starts = events.withColumn("__start", F.explode(window_starts(micros(F.col(time_col)), size, slide)))
    return starts.select(*events.columns, from_micros(F.col("__start")).alias("window_start"), from_micros(F.col("__start") + size).alias("window_end"))


def window_sums(events: DataFrame, time_col: str, key_col: str, value: Column, size_s: int, slide_s: int | None = None) -> DataFrame:
    """(window_start, window_end, key, total, n) per window and key."""
    placed = assign_windows(events.select(F.col(time_col).alias("t"), F.col(key_col).alias("key"), value.alias("v")), "t", size_s, slide_s)
    return placed.groupBy("window_start", "window_end", "key").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def watermarks(events: DataFrame, time_col: str, order: list[str], bound_s: int, bucket: Column) -> DataFrame:
    """`events` with `wm`, the watermark in microseconds after each event in arrival `order`.

    `bucket` ascends with the order (say, the hour of arrival): rows of a bucket share a task, not all rows one.
    """
    return running_max(events, micros(F.col(time_col)), bucket, order, "__most").withColumn("wm", F.col("__most") - bound_s * SECOND).drop("__most")


def exact_windows(events: DataFrame, time_col: str, key_col: str, value_col: str, order: list[str], bucket: Column, size_s: int, bound_s: int, lateness_s: int, slide_s: int | None = None) -> DataFrame:
    """One row per event and window: key, value, window_start and window_end (microseconds), wm, last_wm, and `fate`.

    fate is on_time (watermark not past the window's end), tardy (past it, within the lateness) or too_late. A null
    key is a heartbeat: it moves the watermark and is in no pane, so those rows have no window.
    """
    size = size_s * SECOND
    last = events.agg((F.max(micros(F.col(time_col))) - bound_s * SECOND).alias("last_wm"))  # one row
    marked = watermarks(events, time_col, order, bound_s, bucket).join(F.broadcast(last))
    placed = marked.withColumn("window_start", F.explode_outer(F.when(F.col(key_col).isNotNull(), window_starts(micros(F.col(time_col)), size, slide_s and slide_s * SECOND))))
    end = F.col("window_start") + size
    fate = F.when(F.col("wm") > end + lateness_s * SECOND, "too_late").when(F.col("wm") > end, "tardy").otherwise("on_time")
    return placed.select(*order, F.col(key_col).alias("key"), F.col(value_col).alias("value"), "window_start", end.alias("window_end"), "wm", "last_wm", F.when(F.col("window_start").isNotNull(), fate).alias("fate"))


def emissions(fated: DataFrame, order: list[str]) -> DataFrame:
    """(window_start, window_end, key, revision, total, n): all that a pipeline would emit, from `exact_windows`.

    Revision 1 sums the events on time, once the last watermark is past the end; each tardy event adds one revision.
    """
    panes = ["window_start", "window_end", "key"]
    on_time = fated.where("fate = 'on_time'").groupBy(*panes, "last_wm").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("count"))
    first = on_time.select(*panes, "last_wm", F.lit(0).alias("late"), "value", "count")
    tardy = fated.where("fate = 'tardy'").select(*panes, "last_wm", F.lit(1).alias("late"), "value", F.lit(1).cast("long").alias("count"), *order)
    run = Window.partitionBy(*panes).orderBy("late", *order)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    rows = tardy.unionByName(first, allowMissingColumns=True)
    sums = rows.select(*panes, "last_wm", "late", F.row_number().over(run).cast("long").alias("revision"), F.sum("value").over(upto).alias("total"), F.sum("count").over(upto).alias("n"))
    return sums.where("late = 1 or last_wm > window_end").select(*panes, "revision", "total", "n")


def side_output(fated: DataFrame, order: list[str]) -> DataFrame:
    """Events that came too late, once per expired window."""
    return fated.where("fate = 'too_late'").select(*order, "key", "value", "window_start", "window_end")


def latest_panes(emitted: DataFrame) -> DataFrame:
    """What a keyed sink holds after all emissions, with the number of writes to each pane.

    The key is the whole window and the key, so equal clock times of different days stay apart.
    """
    return emitted.groupBy("window_start", "window_end", "key").agg(F.max_by("total", "revision").alias("total"), F.max_by("n", "revision").alias("n"), F.count(F.lit(1)).alias("writes"))
