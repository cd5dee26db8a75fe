"""Live stage of every batch, running stage metrics and stuck-batch alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from imprint.config import AlertConfig
from imprint.schemas import AUTOMATED_STAGES

STATE_TTL_MS = 2 * 24 * 3600 * 1000

LIVE_STAGE = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("started_at", T.TimestampType()),
    ]
)
STUCK = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
_STATE = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("updated_us", T.LongType()),
        T.StructField("updated_id", T.LongType()),
        T.StructField("started_us", T.LongType()),
    ]
)


def _micros(stamps: pd.Series) -> pd.Series:
    return stamps.astype("datetime64[us]").astype("int64")


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _StageState:
    """Latest stage of one batch, kept for two days after its last event."""

    def __init__(self, handle: StatefulProcessorHandle, ttl_ms: int) -> None:
        self._value = handle.getValueState("stage", _STATE, ttl_ms)

    def add(self, frames: Iterator[pd.DataFrame]) -> tuple[str, int, int, int]:
        best = self._value.get() if self._value.exists() else None
        for frame in frames:
            stamps = _micros(frame["ts"])
            order = pd.DataFrame({"us": stamps, "id": frame["id"]}).sort_values(["us", "id"])
            last = order.index[-1]
            newest = (int(stamps[last]), int(frame["id"][last]))
            first = int(stamps.min())
            if best is None:
                best = (frame["stage"][last], *newest, first)
                continue
            first = min(first, best[3])
            if newest > (best[1], best[2]):
                best = (frame["stage"][last], *newest, first)
            else:
                best = (best[0], best[1], best[2], first)
        self._value.update(tuple(best))
        return tuple(best)


class LiveStage(StatefulProcessor):
    """Emits the current stage of each batch that had events."""

    def __init__(self, ttl_ms: int = STATE_TTL_MS) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stage = _StageState(handle, self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, updated, _, started = self._stage.add(rows)
        yield pd.DataFrame(
            {
                "batch_id": [key[0]],
                "stage": [stage],
                "updated_at": [_stamp(updated)],
                "started_at": [_stamp(started)],
            }
        )

    def close(self) -> None:
        pass


class StuckAlert(StatefulProcessor):
    """Emits a batch once an automated stage has lasted too long.

    A timer is set at each event and fires when no later one replaced it.
    """

    def __init__(self, config: AlertConfig = AlertConfig(), ttl_ms: int = STATE_TTL_MS) -> None:
        self._after_ms = config.stuck_seconds * 1000
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._stage = _StageState(handle, self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage = self._stage.add(rows)[0]
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if stage in AUTOMATED_STAGES:
            now = timerValues.getCurrentProcessingTimeInMs()
            self._handle.registerTimer(now + self._after_ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._stage._value.get()
        if state is not None:
            yield pd.DataFrame(
                {"batch_id": [key[0]], "stage": [state[0]], "updated_at": [_stamp(state[1])]}
            )

    def close(self) -> None:
        pass


def stuck_gaps(events: DataFrame, config: AlertConfig = AlertConfig(), lateness: str = "10 minutes") -> DataFrame:
    """Stream of (batch_id, stage, updated_at): events of automated stages that nothing followed in time.

    As ``stuck_alerts``, but by the times of the events, so a replay gives the same
    alerts. Events no further apart than the limit are one session of their batch, and
    the last event of a session is the one that nothing followed. A session is kept as
    its bounds and last event, until the watermark passes the limit after that event; events
    that come out of order until then are put in their place. An event later than
    ``lateness`` counts only where the limit after it is not past either.
    """
    if config.stuck_seconds <= 0:
        raise ValueError("stuck_seconds must be positive")
    # A session ends with the watermark at its end; one millisecond more makes it pass the end.
    known = events.filter(F.col("ts").isNotNull()).select("batch_id", "id", "ts", "stage").withWatermark(
        "ts", f"{lateness} 1 millisecond"
    )
    last = F.max(F.struct("ts", "id", "stage")).alias("last")
    sessions = known.groupBy("batch_id", F.session_window("ts", f"{config.stuck_seconds} seconds")).agg(last)
    return sessions.filter(F.col("last.stage").isin(*AUTOMATED_STAGES)).select(
        F.col("batch_id").cast("long").alias("batch_id"), "last.stage", F.col("last.ts").alias("updated_at")
    )


def live_stages(events: DataFrame, ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Stream of stage changes, one row per batch and micro-batch."""
    known = events.filter(F.col("ts").isNotNull()).select("batch_id", "id", "ts", "stage")
    return known.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=LiveStage(ttl_ms),
        outputStructType=LIVE_STAGE,
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def stuck_alerts(events: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Stream of batches that stay in an automated stage for too long."""
    known = events.filter(F.col("ts").isNotNull()).select("batch_id", "id", "ts", "stage")
    return known.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=StuckAlert(config),
        outputStructType=STUCK,
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def running_stage_metrics(events: DataFrame, window: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Stage timings kept up to date; with ``window`` per tumbling window of ``ts``.

    Works on a stream and on a table.
    """
    ended = events.filter(F.col("duration_ms").isNotNull())
    keys = [F.col("stage")]
    if window is not None:
        ended = ended.withWatermark("ts", lateness)
        keys.insert(0, F.window("ts", window).alias("window"))
    return ended.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
    )
