"""Timings, counters, feeds, admission, alerts and their streaming forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.config import AdmissionConfig, AlertConfig
from imprint.functions import text
from imprint.operators import telemetry
from imprint.plans import reports
from imprint.session import checkpoint_dir
from imprint.sources.events import parse_log_lines
from imprint.streaming import admission, matching, stages
from workload.registry import query
from workload.scan_queries import _NEW_PAIRS, MATCH, _pair_columns
from workload.tables import Tables

DAILY = AdmissionConfig(max_attempts=3, window_seconds=86400)
ALERTS = AlertConfig()

_SUMMARY = """
SELECT stage, count(*)::BIGINT AS count, count_if(status = 'failed')::BIGINT AS failed_count,
  round(avg(duration_ms), 1) AS avg_duration_ms, max(duration_ms) AS max_duration_ms
FROM stage_events WHERE duration_ms IS NOT NULL GROUP BY stage
"""
_COUNTERS = """
SELECT *, CASE WHEN started > 0 THEN round(failed / started, 4) ELSE 0.0 END AS failure_rate FROM (
  SELECT count_if(status = 'started')::BIGINT AS started, count_if(status = 'succeeded')::BIGINT AS succeeded,
  count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'retried')::BIGINT AS retried FROM task_events)
"""
_LATEST = """
SELECT batch_id, arg_max(stage, (ts, id)) AS stage, max(ts) AS updated_at, min(ts) AS started_at FROM stage_events GROUP BY batch_id
"""
_ADMITTED = """
WITH RECURSIVE ordered AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT key, id, rn, true AS admitted, [us] AS held FROM ordered WHERE rn = 1
  UNION ALL
  SELECT key, id, rn, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END
  FROM (SELECT o.key, o.id, o.rn, o.us, list_filter(w.held, lambda h: o.us - h <= 86400000000) AS live
    FROM walk w JOIN ordered o ON o.key = w.key AND o.rn = w.rn + 1))
SELECT key, id, admitted FROM walk
"""
_NOW = "(SELECT max(ts) FROM stage_events)"


@query("A6", _SUMMARY, "stage_events")
def stage_summary(t: Tables) -> DataFrame:
    return telemetry.stage_summary(t.stage_events)


@query("A7", _COUNTERS, "task_events")
def task_counters(t: Tables) -> DataFrame:
    return telemetry.task_counters(t.task_events)


@query(
    "T5",
    f"""SELECT started, failed, failure_rate, started > 10 AND failed / started > 0.2 AS alert, failure_rate > 0.05 AS warning FROM ({_COUNTERS})""",
    "task_events",
)
def failure_alert(t: Tables) -> DataFrame:
    counters = telemetry.failure_alert(telemetry.task_counters(t.task_events))
    return counters.select("started", "failed", "failure_rate", "alert", "warning")


@query(
    "W2",
    """SELECT stage AS feed, id, position FROM (SELECT stage, id, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, id DESC) AS position
    FROM stage_events) WHERE position <= 20""",
    "stage_events",
)
def recent_items(t: Tables) -> DataFrame:
    feed = t.stage_events.select(F.col("stage").alias("feed"), "ts", "id")
    return telemetry.recent_items(feed).select("feed", "id", F.col("position").cast("long").alias("position"))


@query(
    "W3 T2",
    f"SELECT batch_id, stage, epoch_us(updated_at) AS updated_us, epoch_us(started_at) AS started_us FROM ({_LATEST})",
    "stage_events",
)
def latest_stage(t: Tables) -> DataFrame:
    return _stage_columns(telemetry.latest_stage(t.stage_events))


def _stage_columns(latest: DataFrame) -> DataFrame:
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("updated_at", "started_at")}
    return latest.select(
        "batch_id", "stage", micros["updated_at"].alias("updated_us"), micros["started_at"].alias("started_us")
    )


@query(
    "W3",
    f"SELECT batch_id, stage, epoch_us(updated_at) AS updated_us FROM ({_LATEST}) ORDER BY updated_at DESC, batch_id DESC LIMIT 30",
    "stage_events",
)
def active_batches(t: Tables) -> DataFrame:
    active = telemetry.active_batches(telemetry.latest_stage(t.stage_events))
    return _stage_columns(active).drop("started_us")


_MARKS = (
    "SELECT CAST(event_id - event_id % 2 AS BIGINT) AS task_id, CAST(0 AS BIGINT) AS attempt, "
    "CASE WHEN event_type = 'error' THEN 'lost' WHEN event_id % 2 = 0 THEN 'enqueued' ELSE 'started' END AS mark, ts FROM {rows}"
)


@query(
    "W4",
    f"""SELECT task_id, attempt, (epoch_us(min(CASE WHEN mark = 'started' THEN ts END)) - epoch_us(min(CASE WHEN mark = 'enqueued' THEN ts END))) // 1000 AS queue_wait_ms
    FROM ({_MARKS.format(rows='events')}) GROUP BY task_id, attempt""",
)
def queue_wait(t: Tables) -> DataFrame:
    marks = t.spark.sql(_MARKS, rows=t.given("events"))
    return telemetry.queue_wait(marks)


@query("W5", f"SELECT key, id, admitted FROM ({_ADMITTED})")
def admit_attempts(t: Tables) -> DataFrame:
    return telemetry.admit_attempts(t.attempts, DAILY).select("key", "id", "admitted")


@query(
    "W5",
    """SELECT user_id AS key, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)::BIGINT AS in_window
    FROM events""",
)
def naive_window_counts(t: Tables) -> DataFrame:
    return telemetry.naive_window_counts(t.attempts, DAILY).select("key", "id", "in_window")


@query(
    "T4",
    f"""SELECT batch_id, stage, (epoch_us({_NOW}) - epoch_us(updated_at)) // 60000000 AS minutes FROM ({_LATEST})
    WHERE stage IN ('extracting', 'cropping', 'zip_extraction', 'hashing', 'duplicate_detection')
    AND epoch_us({_NOW}) - epoch_us(updated_at) > 600000000""",
    "stage_events",
)
def stuck_batches(t: Tables) -> DataFrame:
    """As seen at the time of the last event."""
    now = t.stage_events.agg(F.max("ts").alias("now"))
    latest = telemetry.latest_stage(t.stage_events).join(F.broadcast(now))
    stuck = telemetry.stuck_batches(latest, F.col("now").cast("timestamp"))
    return stuck.select("batch_id", "stage", "minutes")


@query(
    "P17",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '***REDACTED***' ELSE props END AS first, 'k' AS second_key, props AS second
    FROM events""",
)
def redact_secrets(t: Tables) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "Access_Token").when(F.col("event_type") == "view", "PASSWORD").otherwise("payload")
    fields = text.redact(F.create_map(name, F.col("props"), F.lit("k"), F.col("props")))
    return t.given("events").select(
        "event_id",
        F.element_at(fields, name).alias("first"),
        F.lit("k").alias("second_key"),
        F.element_at(fields, "k").alias("second"),
    )


@query(
    "P18",
    "SELECT doc_id, substr(text, 1, 500) AS message, right(text, 4000) AS trace FROM documents",
)
def message_caps(t: Tables) -> DataFrame:
    return t.given("documents").select(
        "doc_id", text.cap_message(F.col("text")).alias("message"), text.cap_trace(F.col("text")).alias("trace")
    )


_FAILURES = (
    "SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'zipfile.BadZipFile' WHEN 1 THEN 'RedisError' WHEN 2 THEN 'redis.exceptions.ConnectionError' "
    "WHEN 3 THEN 'OperationalError' WHEN 4 THEN 'botocore.exceptions.ClientError' WHEN 5 THEN 'OSError' WHEN 6 THEN 'PermissionError' "
    "WHEN 7 THEN 'ValueError' WHEN 8 THEN 'KeyError' WHEN 9 THEN 'BotoCoreError' ELSE NULL END AS kind, "
    "concat(CASE WHEN event_id % 2 = 0 THEN 'Crop of ' ELSE 'Read of ' END, event_type) AS message, "
    "CAST(CASE WHEN event_id % 3 = 0 THEN 28 END AS INT) AS errno FROM {rows}"
)


@query(
    "P19",
    f"""SELECT event_id, category, CASE category WHEN 'bad_archive' THEN 422 WHEN 'cache' THEN 503 WHEN 'database' THEN 503 WHEN 'storage' THEN 502
      WHEN 'disk_full' THEN 507 WHEN 'crop' THEN 422 ELSE 500 END::BIGINT AS status_code FROM (
      SELECT event_id, CASE WHEN kind = 'zipfile.BadZipFile' THEN 'bad_archive' WHEN kind IN ('RedisError', 'redis.exceptions.ConnectionError') THEN 'cache'
        WHEN kind = 'OperationalError' THEN 'database' WHEN kind IN ('botocore.exceptions.ClientError', 'BotoCoreError') THEN 'storage'
        WHEN kind IN ('OSError', 'PermissionError') AND errno = 28 THEN 'disk_full' WHEN kind = 'PermissionError' THEN 'permission'
        WHEN kind = 'ValueError' AND contains(lower(message), 'crop') THEN 'crop' ELSE 'other' END AS category
      FROM ({_FAILURES.format(rows='events')}))""",
)
def failure_classes(t: Tables) -> DataFrame:
    rows = t.spark.sql(_FAILURES, rows=t.given("events"))
    found = text.failure_class(F.col("kind"), F.col("message"), F.col("errno"))
    return rows.select("event_id", found["category"].alias("category"), found["status_code"].cast("long").alias("status_code"))


@query(
    "S8",
    """SELECT event_id, event_type AS processing_stage, user_id AS batch_id, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT END AS duration_ms,
    epoch_us(date_trunc('millisecond', ts)) AS ts_us, '***REDACTED***' AS token FROM events""",
)
def parse_log(t: Tables) -> DataFrame:
    """Events written as JSON log lines, then read back."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    line = F.to_json(
        F.struct(
            stamp.alias("timestamp"),
            F.col("event_type").alias("processing_stage"),
            F.col("user_id").alias("batch_id"),
            F.when(F.col("event_type") == "error", F.floor("value")).alias("duration_ms"),
            F.col("props").alias("Token"),
        )
    )
    parsed = parse_log_lines(t.given("events").select("event_id", line.alias("value")))
    return parsed.select(
        "event_id", "processing_stage", "batch_id", "duration_ms",
        F.unix_micros("ts").alias("ts_us"), F.element_at("fields", "Token").alias("token"),
    )


_BY_DAY = """
SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day_s, stage, count(*)::BIGINT AS count, count_if(status = 'failed')::BIGINT AS failed_count,
  round(avg(duration_ms), 1) AS avg_duration_ms, max(duration_ms) AS max_duration_ms FROM stage_events WHERE duration_ms IS NOT NULL GROUP BY 1, 2
"""


@query("T3", _BY_DAY, "stage_events")
def stage_metrics_by_day(t: Tables) -> DataFrame:
    events = t.stage_events.withColumn("ts", F.col("ts").cast("timestamp"))
    metrics = stages.running_stage_metrics(events, "1 day")
    return metrics.withColumn("day_s", F.unix_timestamp("window.start")).drop("window")


def _melted(section: str, source: str, item: str, **fields: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, ({item})::VARCHAR AS item, '{name}' AS field, ({value})::VARCHAR AS value FROM ({source})"
        for name, value in fields.items()
    )


_STAMP = "strftime({t}, '%Y-%m-%d %H:%M:%S.%f')"
_SECTIONS = [
    _melted("batches_by_status", "SELECT status, count(*) AS n FROM batches GROUP BY status", "status", batches="n"),
    _melted(
        "active_batches", f"SELECT * FROM ({_LATEST}) ORDER BY updated_at DESC, batch_id DESC LIMIT 30", "batch_id",
        stage="stage", updated_at=_STAMP.format(t="updated_at"), started_at=_STAMP.format(t="started_at"),
    ),
    _melted(
        "recent",
        """SELECT * FROM (SELECT stage AS feed, ts, id, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, id DESC) AS place
        FROM stage_events) WHERE place <= 20""",
        "feed || '#' || place", ts=_STAMP.format(t="ts"), id="id",
    ),
    _melted(
        "stage_timings", _SUMMARY, "stage", count="count", failed_count="failed_count",
        avg_duration_ms="avg_duration_ms::DECIMAL(20,4)", max_duration_ms="max_duration_ms",
    ),
    _melted(
        "task_counters", _COUNTERS, "'all'", started="started", succeeded="succeeded", failed="failed", retried="retried",
        failure_rate="failure_rate::DECIMAL(20,4)", alert="started > 10 AND failed / started > 0.2", warning="failure_rate > 0.05",
    ),
    _melted(
        "stuck",
        f"""SELECT *, epoch_us({_NOW}) - epoch_us(updated_at) AS age FROM ({_LATEST})
        WHERE stage IN ('extracting', 'cropping', 'zip_extraction', 'hashing', 'duplicate_detection')
        AND epoch_us({_NOW}) - epoch_us(updated_at) > 600000000""",
        "batch_id", stage="stage", age_seconds="(age / 1e6)::DECIMAL(20,4)", minutes="age // 60000000",
    ),
]


@query("C2", " UNION ALL ".join(_SECTIONS), "stage_events task_events batches")
def health_report(t: Tables) -> DataFrame:
    """All six sections of the status page as one long table, as seen at the time of the last event."""
    feed = t.stage_events.select(F.col("stage").alias("feed"), "ts", "id")
    now = F.lit(t.stage_events.agg(F.max("ts")).first()[0]).cast("timestamp")
    return reports.report_lines(reports.health_report(t.batches, t.stage_events, t.task_events, feed, now))


def _arrivals(rows: DataFrame, groups: int, again: str | None = None) -> Iterator[tuple[DataFrame, str]]:
    """The rows as a stream that grows by id, one group of files at a time, and a folder for the query.

    With ``again`` a group also brings those rows of the groups before that meet the
    condition, and its own ones twice. A group is written by as many tasks as the rows have, and read as one
    micro-batch by a query that is run to its end before the next group comes.
    """
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    source = f"{root}/source"
    cuts = rows.approxQuantile("id", [i / groups for i in range(1, groups)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows if low is None else rows.filter(F.col("id") > low)
        part = part if high is None else part.filter(F.col("id") <= high)
        if again is not None:
            before = rows.limit(0) if low is None else rows.filter(F.col("id") <= low).filter(again)
            part = part.union(part.filter(again)).union(before)
        part.write.mode("append").parquet(source)
        yield spark.readStream.schema(rows.schema).parquet(source), root


@query("T1 T7", _NEW_PAIRS, "hits")
def incremental_matching(t: Tables) -> DataFrame:
    """All prints as a growing stream in which every third is delivered again and again, each micro-batch matched against those before it."""
    for stream, root in _arrivals(t.prints, 4, "id % 3 = 0"):
        matching.start_matching(stream, f"{root}/index", f"{root}/checkpoint", MATCH).awaitTermination()
    pairs = matching.IncrementalMatcher(f"{root}/index", MATCH).pairs(t.spark)
    # Which side of a pair was the query follows from arrival, which is by id here.
    return _pair_columns(pairs)


# The state store that keyed state needs. Micro-batches without rows are off unless
# asked for: a processing-time clock would want them without end.
_STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def _run_stateful(
    rows: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str, idle_batches: bool = False
) -> DataFrame:
    """Everything ``operator`` emits on a stream of the rows, with the ``epoch`` it came in.

    ``idle_batches`` lets a last micro-batch without rows move the watermark.
    """
    spark = rows.sparkSession
    settings = {**_STATEFUL, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for stream, root in _arrivals(rows, 4):

            def keep(out: DataFrame, epoch: int, root: str = root) -> None:
                out.write.mode("overwrite").parquet(f"{root}/output/epoch={epoch}")

            writer = operator(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
            running = writer.foreachBatch(keep).trigger(availableNow=True).start()
            if not running.awaitTermination(600):
                running.stop()
                raise TimeoutError("stream did not end")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.parquet(f"{root}/output")


@query(
    "T2",
    f"SELECT batch_id, stage, epoch_us(updated_at) AS updated_us, epoch_us(started_at) AS started_us FROM ({_LATEST})",
    "stage_events",
)
def live_stages(t: Tables) -> DataFrame:
    """Keyed state over a stream of events; the last state of each batch."""
    events = t.stage_events.withColumn("ts", F.col("ts").cast("timestamp"))
    states = _run_stateful(events, stages.live_stages, "update")
    last = states.groupBy("batch_id").agg(
        *[F.max_by(c, "epoch").alias(c) for c in ("stage", "updated_at", "started_at")]
    )
    return _stage_columns(last)


@query("T6", f"SELECT key::VARCHAR AS key, id, admitted FROM ({_ADMITTED})")
def admit_stream(t: Tables) -> DataFrame:
    attempts = t.attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    return _run_stateful(attempts, lambda stream: admission.admit_stream(stream, DAILY), "append").drop("epoch")


@query(
    "T4",
    """SELECT batch_id, stage, us AS updated_us FROM (
      SELECT batch_id, stage, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY batch_id ORDER BY ts, id) AS next FROM stage_events),
      (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM stage_events)
    WHERE stage IN ('extracting', 'cropping', 'zip_extraction', 'hashing', 'duplicate_detection')
    AND (next - us > 600000000 OR (next IS NULL AND ceil(us / 1000) + 600001 <= mark))""",
    "stage_events",
)
def stuck_gaps_stream(t: Tables) -> DataFrame:
    """Alerts over a stream of events, by timers on their own times."""
    events = t.stage_events.withColumn("ts", F.col("ts").cast("timestamp"))
    alerts = _run_stateful(events, stages.stuck_gaps, "append", idle_batches=True)
    return alerts.select("batch_id", "stage", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query("T3", _BY_DAY, "stage_events")
def running_stage_metrics(t: Tables) -> DataFrame:
    """Timings by day kept up to date over a stream of events, as they stand at its end."""
    events = t.stage_events.withColumn("ts", F.col("ts").cast("timestamp"))
    states = _run_stateful(events, lambda stream: stages.running_stage_metrics(stream, "1 day"), "complete")
    last = states.agg(F.max("epoch").alias("last"))
    return (
        states.join(F.broadcast(last), states.epoch == F.col("last")).drop("epoch", "last")
        .withColumn("day_s", F.unix_timestamp("window.start")).drop("window")
    )
