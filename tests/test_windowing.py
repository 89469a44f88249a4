"""The closed form of event-time windows against a pipeline that takes one event at a time."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import windowing as W

BASE = datetime(2026, 1, 1, 12)
US = W.SECOND


def one_at_a_time(events, size, slide, bound, lateness):
    """events: (key or None, value, second). Emissions in order and late (event, window) pairs."""
    panes, out, late, top = {}, [], [], None
    for key, value, second in events:
        top = second if top is None else max(top, second)
        wm = top - bound
        start = second - second % slide
        while key is not None and start > second - size:
            if wm > start + size + lateness:
                late.append((key, value, start))
            else:
                pane = panes.setdefault((start, key), {"sum": 0, "n": 0, "sent": 0, "dirty": False})
                pane["sum"] += value
                pane["n"] += 1
                pane["dirty"] = True
            start -= slide
        for (start, key_), pane in sorted(panes.items()):
            if wm > start + size and pane["dirty"]:
                pane["sent"] += 1
                pane["dirty"] = False
                out.append((start, key_, pane["sent"], pane["sum"], pane["n"]))
    return out, late


def frame_of(spark, events):
    rows = [(i, k, v, BASE + timedelta(seconds=s)) for i, (k, v, s) in enumerate(events)]
    return spark.createDataFrame(rows, "i long, key string, value long, ts timestamp_ntz")


def closed_form(spark, events, size, slide, bound, lateness):
    fated = W.exact_windows(frame_of(spark, events), "ts", "key", "value", ["i"], F.floor(F.col("i") / 3), size, bound, lateness, slide)
    zero = int((BASE - datetime(1970, 1, 1)).total_seconds())
    second = lambda us: us // US - zero
    sent = sorted((second(r.window_start), r.key, r.revision, r.total, r.n) for r in W.emissions(fated, ["i"]).collect())
    late = sorted((r.key, r.value, second(r.window_start)) for r in W.side_output(fated, ["i"]).collect())
    return sent, late, fated


CASES = {
    "watermark": ([("k", 1, 1), ("k", 2, 3), ("k", 1, 11)], 10, 2, 0, []),
    "fires": ([("k", 1, 1), ("k", 2, 3), ("k", 1, 11), ("k", 1, 13)], 10, 2, 0, [(0, "k", 1, 3, 2)]),
    "lateness": ([("k", 1, 1), ("k", 1, 14), ("k", 10, 4)], 10, 2, 5, [(0, "k", 1, 1, 1), (0, "k", 2, 11, 2)]),
    "too late": ([("k", 1, 1), ("k", 1, 30), ("k", 99, 2)], 10, 1, 2, [(0, "k", 1, 1, 1)]),
    "heartbeat": ([("a", 1, 1), ("b", 2, 2), ("a", 3, 3), (None, 0, 30)], 10, 2, 0, [(0, "a", 1, 4, 2), (0, "b", 1, 2, 1)]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    events, size, bound, lateness, want = CASES[name]
    sent, late, _ = closed_form(spark, events, size, size, bound, lateness)
    assert sent == sorted(want)
    assert late == ([("k", 99, 0)] if name == "too late" else [])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 9), st.integers(0, 40)), min_size=1, max_size=25), st.sampled_from([(10, 10), (10, 5), (9, 4)]), st.integers(0, 5), st.integers(0, 8))
def test_equals_one_event_at_a_time(spark, events, shape, bound, lateness):
    size, slide = shape
    # Windows are aligned to year 1; shift the seconds so that the model's multiples are the same.
    zero = int((BASE - datetime(1970, 1, 1)).total_seconds()) + W.YEAR_ONE
    shifted = [(k, v, s + (-zero) % slide) for k, v, s in events]
    sent, late, _ = closed_form(spark, shifted, size, slide, bound, lateness)
    want, want_late = one_at_a_time([(k, v, s + zero) for k, v, s in shifted], size, slide, bound, lateness)
    assert sent == sorted((s - zero, *r) for s, *r in want)
    assert late == sorted((k, v, s - zero) for k, v, s in want_late)


def test_order_within_the_bound_changes_nothing(spark):
    values = {1: 10, 2: 20, 3: 30, 4: 40, 5: 50}
    runs = [[("k", values[s], s) for s in order] + [(None, 0, 20)] for order in ([1, 2, 3, 4, 5], [5, 1, 4, 2, 3])]
    assert closed_form(spark, runs[0], 10, 10, 3, 0)[0] == closed_form(spark, runs[1], 10, 10, 3, 0)[0] == [(0, "k", 1, 150, 5)]


def test_replay_reaches_the_same_state_with_more_writes(spark):
    run = [("a", 1, 1), ("b", 2, 2), ("a", 3, 3), (None, 0, 30)]
    once = W.latest_panes(W.emissions(closed_form(spark, run, 10, 10, 2, 0)[2], ["i"]))
    assert sorted((r.key, r.total, r.writes) for r in once.collect()) == [("a", 4, 1), ("b", 2, 1)]


def test_assigners(spark):
    starts = lambda seconds, size, slide=None: [[int((x - BASE).total_seconds()) for x in sorted(g)] for g in [[r.window_start for r in W.assign_windows(frame_of(spark, [("k", 1, s)]), "ts", size, slide).collect()] for s in seconds]]
    assert starts([0, 9, 10, 19, 25], 10) == [[0], [0], [10], [10], [20]]
    assert starts([12], 10, 5) == [[5, 10]]
    assert starts([3, 12, 19], 5, 10) == [[0], [10], []]


def test_days_apart_stay_apart_in_the_sink(spark):
    events = [("k", 1, 1), ("k", 2, 86401), (None, 0, 90000)]
    fated = closed_form(spark, events, 10, 10, 0, 0)[2]
    assert W.latest_panes(W.emissions(fated, ["i"])).count() == 2


def test_weeks_begin_on_monday_and_odd_sizes_count_from_year_one(spark):
    week = W.assign_windows(frame_of(spark, [("k", 1, 0)]), "ts", 7 * 86400).first().window_start
    assert week == datetime(2025, 12, 29)
    seven = W.assign_windows(frame_of(spark, [("k", 1, 0)]), "ts", 420).first().window_start
    assert (seven - datetime(1, 1, 1)).total_seconds() % 420 == 0
