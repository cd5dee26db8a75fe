"""Everything an operator of the pipeline looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.config import AlertConfig
from imprint.operators.status import batches_by_status
from imprint.operators.telemetry import (
    active_batches,
    failure_alert,
    latest_stage,
    recent_items,
    stage_summary,
    stuck_batches,
    task_counters,
)


def health_report(
    batches: DataFrame,
    stage_events: DataFrame,
    task_events: DataFrame,
    feed_items: DataFrame,
    now: Column,
    config: AlertConfig = AlertConfig(),
) -> dict[str, DataFrame]:
    """The sections of the status page."""
    latest = latest_stage(stage_events)
    return {
        "batches_by_status": batches_by_status(batches),
        "active_batches": active_batches(latest),
        "recent": recent_items(feed_items),
        "stage_timings": stage_summary(stage_events),
        "task_counters": failure_alert(task_counters(task_events), config),
        "stuck": stuck_batches(latest, now, config),
    }


def _text(rows: DataFrame, column: str) -> Column:
    """Values as text that reads the same everywhere: microseconds, four decimals."""
    kind = dict(rows.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)
    if kind in ("double", "float"):
        return F.col(column).cast("decimal(20,4)").cast("string").alias(column)
    return F.col(column).cast("string").alias(column)


def report_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """The sections as one table of (section, item, field, value)."""

    def melted(name: str, rows: DataFrame) -> DataFrame:
        texts = rows.select([_text(rows, c) for c in rows.columns])
        if name == "task_counters":
            texts = texts.withColumn("_item", F.lit("all"))
        elif name == "recent":
            texts = texts.withColumn("_item", F.concat_ws("#", "feed", "position")).drop("feed", "position")
        else:
            texts = texts.withColumnRenamed(texts.columns[0], "_item")
        values = [c for c in texts.columns if c != "_item"]
        return texts.unpivot(["_item"], values, "field", "value").select(
            F.lit(name).alias("section"), F.col("_item").alias("item"), "field", "value"
        )

    lines = None
    for name, rows in sections.items():
        part = melted(name, rows)
        lines = part if lines is None else lines.unionByName(part)
    return lines
