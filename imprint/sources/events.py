"""JSON log lines as event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.functions.text import redact
from imprint.schemas import LOG_LINE


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of each JSON line; absent ones are NULL, a broken line is ``malformed``.

    Messages and traces are kept whole; feeds cap them where they are shown.
    ``fields`` keeps every field as text, with secrets hidden.
    """
    parsed = lines.withColumn("_line", F.from_json(column, LOG_LINE)).withColumn(
        "_all", F.from_json(column, "map<string,string>")
    )
    return parsed.select(
        *[c for c in lines.columns if c != column],
        F.try_to_timestamp("_line.timestamp").alias("ts"),
        *[F.col(f"_line.{f}") for f in LOG_LINE.fieldNames() if f != "timestamp"],
        redact(F.col("_all")).alias("fields"),
        (F.size(F.coalesce("_all", F.create_map().cast("map<string,string>"))) == 0).alias("malformed"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.readStream.text(path))
