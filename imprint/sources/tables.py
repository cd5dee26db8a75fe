"""The pipeline tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imprint.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A pipeline table with its fixed schema; nothing is inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(
    df: DataFrame, root: str, name: str, partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}")


def append_audit(audit: DataFrame, root: str) -> None:
    """Add audit rows; the log is never rewritten."""
    columns = TABLES["audit_log"].fieldNames()
    audit.select(*columns).write.mode("append").parquet(f"{root}/audit_log")


def append_notes(notes: DataFrame, root: str) -> None:
    """Add the rows of ``failure_notes`` that belong to appended audit rows."""
    columns = TABLES["audit_notes"].fieldNames()
    notes.select(*columns).write.mode("append").parquet(f"{root}/audit_notes")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, tasks: int, **options) -> DataFrame:
    """A relational table read in key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=tasks, **options
    )
    return reader.load()
