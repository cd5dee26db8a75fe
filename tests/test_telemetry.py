import datetime as dt
import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint import AdmissionConfig
from imprint.functions import text
from imprint.functions.windows import admit
from imprint.operators import telemetry
from imprint.sources.events import parse_log_lines

T0 = dt.datetime(2024, 1, 1)


def plain_admission(rows, most, window):
    held, out = {}, {}
    for key, seconds, id in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        queue = held.setdefault(key, deque())
        while queue and seconds - queue[0] > window:
            queue.popleft()
        out[id] = len(queue) < most
        if out[id]:
            queue.append(seconds)
    return out


def attempts(spark, rows):
    stamped = [(k, T0 + dt.timedelta(seconds=s), i) for k, s, i in rows]
    return spark.createDataFrame(stamped, "key string, ts timestamp, id long")


def test_admission_of_two_keys(spark):
    rows = [("a", i, i) for i in range(4)] + [("b", 3, 10), ("a", 60, 11), ("a", 61, 12)]
    got = {r.id: r.admitted for r in telemetry.admit_attempts(attempts(spark, rows), AdmissionConfig(3, 60)).collect()}
    # An attempt exactly a window old still counts; a moment later it does not.
    assert got == {0: True, 1: True, 2: True, 3: False, 10: True, 11: False, 12: True}


@pytest.mark.parametrize("spread", [400, 4000, 60000])
def test_admission_equals_the_plain_queue(spark, spread):
    """A hot key spans many time slices, with and without pauses."""
    rng = random.Random(spread)
    rows = [(rng.choice("aaaab"), rng.randint(0, spread) * 2, i) for i in range(600)]
    config = AdmissionConfig(3, 10)
    got = {r.id: r.admitted for r in telemetry.admit_attempts(attempts(spark, rows), config).collect()}
    assert got == plain_admission(rows, 3, 10)
    naive = {r.id: r.in_window for r in telemetry.naive_window_counts(attempts(spark, rows), config).collect()}
    assert naive == {i: sum(1 for k, s, _ in rows if k == key and at - 10 <= s <= at) for key, at, i in rows}


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, batch_id long, stage string, status string, duration_ms long")


def test_summaries(spark):
    df = events(spark, [
        (1, T0, 1, "hashing", "started", None), (2, T0, 1, "hashing", "finished", 10), (3, T0, 1, "hashing", "failed", 15),
        (4, None, 2, "cropping", "finished", 7),
    ])
    got = {r.stage: tuple(r)[1:] for r in telemetry.stage_summary(df).collect()}
    assert got == {"hashing": (2, 1, 12.5, 15), "cropping": (1, 0, 7.0, 7)}
    assert [tuple(r)[:2] for r in telemetry.latest_stage(df).collect()] == [(1, "hashing")]


def test_counters_without_tasks(spark):
    none = spark.createDataFrame([], "status string")
    row = telemetry.failure_alert(telemetry.task_counters(none)).first()
    assert (row.started, row.failure_rate, row.alert, row.warning) == (0, 0.0, False, False)


@pytest.mark.parametrize("started, failed, alert", [(10, 9, False), (11, 2, False), (11, 3, True), (100, 20, False)])
def test_failure_alert_bounds(spark, started, failed, alert):
    rows = [("started",)] * started + [("failed",)] * failed
    counters = telemetry.task_counters(spark.createDataFrame(rows, "status string"))
    assert telemetry.failure_alert(counters).first().alert is alert


def test_stuck_only_in_automated_stages(spark):
    now = T0 + dt.timedelta(seconds=601)
    df = events(spark, [(1, T0, 1, "hashing", "started", None), (2, T0, 2, "rotation_review", "started", None), (3, T0 + dt.timedelta(seconds=1), 3, "cropping", "started", None)])
    stuck = telemetry.stuck_batches(telemetry.latest_stage(df), F.lit(now))
    assert [(r.batch_id, r.minutes) for r in stuck.collect()] == [(1, 10)]


def test_feed_cap(spark):
    items = spark.range(300).selectExpr("'f' AS feed", "timestamp_seconds(id) AS ts", "id")
    assert telemetry.recent_items(items, 15).count() == 15
    assert telemetry.recent_items(items, 100).agg(F.min("id"), F.count("*")).first() == (250, 50)


def test_queue_wait(spark):
    rows = [(1, 0, "enqueued", T0), (1, 0, "started", T0 + dt.timedelta(milliseconds=1500)), (2, 0, "started", T0)]
    got = {r.task_id: r.queue_wait_ms for r in telemetry.queue_wait(spark.createDataFrame(rows, "task_id long, attempt int, mark string, ts timestamp")).collect()}
    assert got == {1: 1500, 2: None}


def test_log_lines(spark):
    full = {"timestamp": "2024-01-01T00:00:01.250Z", "message": "m", "batch_id": 4, "Password": "x", "stack_trace": "a" * 10 + "b" * 4000, "exception_message": "e" * 600}
    lines = spark.createDataFrame([(json.dumps(full),), ("{}",), ("broken",)], "value string")
    rows = parse_log_lines(lines).collect()
    assert rows[0].ts == T0 + dt.timedelta(seconds=1.25) and rows[0].batch_id == 4
    assert rows[0].fields["Password"] == text.REDACTED and rows[0].fields["message"] == "m"
    assert rows[0].stack_trace == "a" * 10 + "b" * 4000 and len(rows[0].exception_message) == 600
    assert rows[1].ts is None and [r.malformed for r in rows] == [False, True, True]


@pytest.mark.parametrize(
    "kind, message, errno, expected",
    [
        ("BadZipFile", "", None, ("bad_archive", 422)), ("redis.exceptions.TimeoutError", "", None, ("cache", 503)),
        ("sqlalchemy.exc.OperationalError", "", None, ("database", 503)), ("ClientError", "", None, ("storage", 502)),
        ("OSError", "", 28, ("disk_full", 507)), ("PermissionError", "", 13, ("permission", 500)),
        ("ValueError", "Could not CROP", None, ("crop", 422)), ("ValueError", "bad", None, ("other", 500)), (None, None, None, ("other", 500)),
    ],
)
def test_failure_class(spark, kind, message, errno, expected):
    column = text.failure_class(*(F.lit(v).cast(t) for v, t in ((kind, "string"), (message, "string"), (errno, "int"))))
    assert tuple(spark.range(1).select(column).first()[0]) == expected


@pytest.mark.parametrize("most", [0, 1, 3])
def test_admission_kernel_goes_on_where_it_stopped(most):
    rng = np.random.default_rng(most)
    times = np.sort(rng.integers(0, 400, 300))
    held, got = times[:0], []
    for part in np.split(times, [1, 40, 40, 200]):
        admitted, held = admit(part, held, most, 10)
        got += admitted.tolist()
    want, last = [], []
    for t in times.tolist():
        last = [x for x in last if t - x <= 10]
        want.append(len(last) < most)
        last += [t] * want[-1]
    assert got == want
