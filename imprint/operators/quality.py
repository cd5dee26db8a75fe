"""Audit of the constraints a relational store would enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.schemas import BATCH_STATUSES, CANDIDATE_STATUSES, SCAN_STATUSES, SIDES

#: Stands for no parent table: marks of it are violations already.
_NONE = "none"


def _mark(condition: Column, rule: str, parent: str, ref: Column) -> Column:
    entry = F.struct(F.lit(rule).alias("rule"), F.lit(parent).alias("parent"), ref.cast("string").alias("ref"))
    return F.when(condition, entry)


def outside_vocabulary(column: str, allowed: list[str], rule: str) -> Column:
    return _mark(~F.col(column).isin(allowed), rule, _NONE, F.col("id"))


def missing(column: str, rule: str) -> Column:
    return _mark(F.col(column).isNull(), rule, _NONE, F.col("id"))


def refers_to(parent: str, column: str, rule: str) -> Column:
    """A reference that is looked up in another table."""
    return _mark(F.col(column).isNotNull(), rule, parent, F.col(column))


def marks(rows: DataFrame, *checks: Column) -> DataFrame:
    """(rule, key, parent, ref) of all that a table's rows break or refer to, in one pass."""
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return rows.select(F.col("id").cast("string").alias("key"), F.explode(found).alias("x")).select("x.rule", "key", "x.parent", "x.ref")


def unbroken(found: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(rule, key) of the marks that no parent row answers: one join for all tables."""
    known = reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(name).alias("parent"), F.col("id").cast("string").alias("ref")) for name, rows in parents.items()],
    )
    # An anti join would be taken into every table's branch, and all parents with it.
    answered = found.join(known.withColumn("answered", F.lit(True)), ["parent", "ref"], "left")
    return answered.filter(F.col("answered").isNull()).select("rule", "key")


def repeated(values: DataFrame) -> DataFrame:
    """(rule, key) of values (``rule``, ``key``) that must be unique and are not."""
    counted = values.filter(F.col("key").isNotNull()).groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1").select("rule", "key")


def constraint_audit(
    batches: DataFrame, scans: DataFrame, crops: DataFrame, candidates: DataFrame, users: DataFrame
) -> DataFrame:
    """Every violation as (rule, key).

    Each table is read once for all rules of its rows and once for each other use: as
    the parent of references, and where a column must be unique.
    """
    found = [
        marks(batches, outside_vocabulary("status", BATCH_STATUSES, "batch_status")),
        marks(
            scans,
            outside_vocabulary("status", SCAN_STATUSES, "scan_status"),
            outside_vocabulary("side", SIDES, "scan_side"),
            missing("original_filename", "scan_filename_missing"),
            missing("r2_key_raw", "scan_key_missing"),
            missing("batch_id", "scan_batch_missing"),
            refers_to("batches", "batch_id", "scan_without_batch"),
        ),
        marks(crops, refers_to("scans", "raw_scan_id", "crop_without_scan")),
        marks(
            candidates,
            outside_vocabulary("status", CANDIDATE_STATUSES, "candidate_status"),
            refers_to("crops", "card_crop_id_a", "pair_without_first"),
            refers_to("crops", "card_crop_id_b", "pair_without_second"),
            refers_to("users", "reviewed_by", "pair_without_reviewer"),
        ),
    ]
    parents = {"batches": batches, "scans": scans, "crops": crops, "users": users}
    unique = [
        crops.select(F.lit("crop_scan_unique").alias("rule"), F.col("raw_scan_id").cast("string").alias("key")),
        users.select(F.lit("user_name_unique").alias("rule"), F.col("name").alias("key")),
    ]
    broken = unbroken(reduce(DataFrame.unionByName, found), parents)
    return broken.unionByName(repeated(reduce(DataFrame.unionByName, unique)))
