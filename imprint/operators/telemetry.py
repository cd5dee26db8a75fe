"""Stage timings, counters, feeds, waits, admission and alerts.

A *stage event* has ``id``, ``ts``, ``batch_id``, ``stage``, ``status`` (started,
finished or failed) and ``duration_ms``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.config import AdmissionConfig, AlertConfig
from imprint.functions.windows import admit
from imprint.schemas import AUTOMATED_STAGES

FEED_LENGTH = 50


def stage_summary(events: DataFrame) -> DataFrame:
    """Ended runs of each stage: count, failures, mean and longest duration."""
    ended = events.filter(F.col("duration_ms").isNotNull())
    return ended.groupBy("stage").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )


def failure_rate(failed: Column, started: Column) -> Column:
    """Share of failed tasks, 0 when none was started."""
    return F.when(started > 0, F.round(failed / F.nullif(started, F.lit(0)), 4)).otherwise(0.0)


def task_counters(events: DataFrame) -> DataFrame:
    """Totals of task states (``status``) and their failure rate: one row."""
    status = F.col("status")
    counted = events.agg(
        *[F.count_if(status == s).alias(s) for s in ("started", "succeeded", "failed", "retried")]
    )
    return counted.withColumn("failure_rate", failure_rate(F.col("failed"), F.col("started")))


def recent_items(items: DataFrame, newest: int = 20, cap: int = FEED_LENGTH) -> DataFrame:
    """Newest items of each feed; no feed keeps more than ``cap``.

    ``items`` has ``feed``, ``ts`` and ``id``. The rank filter is applied before
    the shuffle as well as after it.
    """
    order = Window.partitionBy("feed").orderBy(F.desc("ts"), F.desc("id"))
    return items.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= min(newest, cap)
    )


def latest_stage(events: DataFrame) -> DataFrame:
    """Current stage of each batch, when it was reached, when work started.

    ``events`` may lack timestamps that could not be read; those are skipped.
    """
    known = events.filter(F.col("ts").isNotNull())
    return known.groupBy("batch_id").agg(
        F.max_by("stage", F.struct("ts", "id")).alias("stage"),
        F.max("ts").alias("updated_at"),
        F.min("ts").alias("started_at"),
    )


def active_batches(latest: DataFrame, limit: int = 30, include_terminal: bool = True) -> DataFrame:
    """Most recently updated batches, finished ones included by default."""
    if not include_terminal:
        latest = latest.filter(~F.col("stage").isin("complete", "failed"))
    return latest.orderBy(F.desc("updated_at"), F.desc("batch_id")).limit(limit)


def queue_wait(marks: DataFrame) -> DataFrame:
    """Milliseconds from enqueueing to start of every task attempt.

    ``marks`` has ``task_id``, ``attempt``, ``mark`` (enqueued or started) and
    ``ts``. NULL when an attempt was never stamped or never started.
    """

    def at(mark: str) -> Column:
        return F.min(F.when(F.col("mark") == mark, F.unix_micros("ts")))

    return (
        marks.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy("task_id", "attempt")
        .agg(at("enqueued").alias("_from"), at("started").alias("_to"))
        .select(
            "task_id", "attempt",
            F.expr("(_to - _from) div 1000").alias("queue_wait_ms"),
        )
    )


def stuck_batches(latest: DataFrame, now: Column, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Batches too long in a stage that runs without a human."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / 1e6
    return (
        latest.filter(F.col("stage").isin(AUTOMATED_STAGES))
        .withColumn("age_seconds", age)
        .filter(F.col("age_seconds") > config.stuck_seconds)
        .withColumn("minutes", F.floor(F.col("age_seconds") / 60))
        .select("batch_id", "stage", "age_seconds", "minutes")
    )


def failure_alert(counters: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Counters with ``alert`` and the earlier ``warning``."""
    rate = F.col("failed") / F.nullif(F.col("started"), F.lit(0))
    alert = (F.col("started") > config.min_tasks) & (rate > config.failure_rate)
    return counters.withColumns(
        {
            "alert": F.coalesce(alert, F.lit(False)),
            "warning": F.col("failure_rate") > config.warning_rate,
        }
    )


def _with_segments(attempts: DataFrame, window_us: int) -> DataFrame:
    """Add ``_segment``: stretches of a key that cannot influence each other.

    A gap longer than the window empties it, so whatever follows starts afresh.
    Gaps are found inside time slices of a key, and across slices from one row
    per slice, so that a hot key is cut into slices instead of being sorted in a
    single task.
    """
    slice_us = max(window_us * 60, 60_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    sliced = attempts.withColumn("_us", at).withColumn("_slice", F.expr(f"_us div {slice_us}"))
    inside = Window.partitionBy("key", "_slice").orderBy("_us", "id")
    marked = sliced.withColumn(
        "_opens", F.col("_us") - F.lag("_us").over(inside) > window_us
    )
    slices = marked.groupBy("key", "_slice").agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.min(F.when(F.col("_opens"), F.col("_us"))).alias("_first_gap"),
        F.max(F.when(F.col("_opens"), F.col("_us"))).alias("_last_gap"),
    )
    along = Window.partitionBy("key").orderBy("_slice")
    before = F.lag("_last").over(along)
    fresh = before.isNull() | (F.col("_first") - before > window_us)
    opened = slices.withColumn(
        # Where the last segment of this slice starts, if one starts in it.
        "_tail", F.coalesce("_last_gap", F.when(fresh, F.col("_first")))
    )
    inherited = F.last("_tail", ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, -1)
    )
    bounds = opened.withColumn("_carried", F.when(fresh, F.col("_first")).otherwise(inherited))
    started = F.max(F.when(F.col("_opens"), F.col("_us"))).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        marked.withColumn("_started", started)
        .join(bounds.select("key", "_slice", "_carried"), ["key", "_slice"])
        .withColumn("_segment", F.coalesce("_started", "_carried"))
        .drop("_slice", "_opens", "_started", "_carried")
    )


def admit_attempts(attempts: DataFrame, config: AdmissionConfig = AdmissionConfig()) -> DataFrame:
    """Add ``admitted`` under the sliding-window limit of each key.

    ``attempts`` has ``key``, ``ts`` and ``id`` (which breaks ties). An attempt
    is admitted unless ``max_attempts`` admitted ones lie within the window
    before it, one exactly a window old included; refused attempts are not
    recorded. The rule is recursive, so rows are walked in order; the walk keeps
    only ``max_attempts`` times and streams through sorted partitions, cut
    wherever a key pauses for longer than the window.
    """
    window_us = round(config.window_seconds * 1_000_000)
    most = config.max_attempts

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, np.empty(0, np.int64)
        for batch in batches:
            keys = batch.column("key")
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            segments, times = (batch.column(c).to_numpy() for c in ("_segment", "_us"))
            changes = np.flatnonzero((np.diff(codes) != 0) | (np.diff(segments) != 0)) + 1
            starts = [0, *changes.tolist()] if batch.num_rows else []
            admitted = np.zeros(batch.num_rows, bool)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                if (run := (keys[start].as_py(), segments[start])) != current:
                    current, held = run, held[:0]
                admitted[start:end], held = admit(times[start:end], held, most, window_us)
            kept = batch.drop_columns(["_us", "_segment"])
            yield kept.append_column("admitted", pa.array(admitted, pa.bool_()))

    segmented = _with_segments(attempts, window_us)
    schema = T.StructType([*attempts.schema.fields, T.StructField("admitted", T.BooleanType())])
    ordered = (
        segmented.select(*attempts.columns, "_us", "_segment")
        .repartition("key", "_segment")
        .sortWithinPartitions("key", "_segment", "_us", "id")
    )
    return ordered.mapInArrow(walk, schema)


def naive_window_counts(attempts: DataFrame, config: AdmissionConfig = AdmissionConfig()) -> DataFrame:
    """Add ``in_window``: all attempts of the key within the window, this one included.

    The plain sliding count, which also counts attempts that would be refused.
    """
    window_us = round(config.window_seconds * 1_000_000)
    slice_us = max(window_us * 60, 60_000_000)
    timed = attempts.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    # A hot key is cut into time slices; the end of a slice is also seen by the next.
    home = F.expr(f"_us div {slice_us}")
    reaches_next = F.expr(f"_us % {slice_us} >= {slice_us - window_us}")
    visits = timed.withColumn("_home", home).withColumn(
        "_slice",
        F.explode(
            F.when(reaches_next, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))
        ),
    )
    frame = Window.partitionBy("key", "_slice").orderBy("_us").rangeBetween(-window_us, 0)
    counted = visits.withColumn("in_window", F.count(F.lit(1)).over(frame))
    return counted.filter("_slice = _home").drop("_us", "_home", "_slice")
