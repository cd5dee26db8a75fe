"""Sliding-window admission on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from imprint.config import AdmissionConfig
from imprint.functions.windows import admit

ADMISSION = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("admitted", T.BooleanType()),
    ]
)


class Admission(StatefulProcessor):
    """Keeps the times of the admitted attempts of one key, never more than the limit.

    Attempts are taken in the order of their times within a micro-batch. A timer drops
    the key once the watermark is a window past its last admitted attempt: what can
    still come is admitted or refused without it.
    """

    def __init__(self, config: AdmissionConfig = AdmissionConfig()) -> None:
        self._most = config.max_attempts
        self._window_us = round(config.window_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState(
            "admitted", T.StructType([T.StructField("us", T.LongType())])
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [row[0] for row in self._held.get()] if self._held.exists() else []
        # Only two numbers of each row are gathered.
        parts = [(r["ts"].astype("datetime64[us]").astype("int64").to_numpy(), r["id"].to_numpy()) for r in rows]
        us, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, us))
        us, ids = us[order], ids[order]
        admitted, last = admit(us, np.array(held, np.int64), self._most, self._window_us)
        if len(last):
            self._held.put([(int(t),) for t in last])
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(int(last[-1] + self._window_us) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "id": ids, "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._held.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit_stream(
    attempts: DataFrame, config: AdmissionConfig = AdmissionConfig(), lateness: str = "10 minutes"
) -> DataFrame:
    """Stream of (key, id, admitted) for attempts with ``key``, ``id`` and ``ts``.

    Time is that of the attempts: one that comes when later ones by more than
    ``lateness`` have been there is too late and has no row, so replaying old events
    changes nothing. A key holds state for one window (and the lateness) after its last
    admitted attempt.
    """
    return (
        attempts.select(attempts["key"].cast("string").alias("key"), "id", "ts")
        .withWatermark("ts", lateness)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=Admission(config),
            outputStructType=ADMISSION,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
