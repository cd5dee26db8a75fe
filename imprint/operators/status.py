"""State of a batch, derived from its scans, crops and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.functions.numeric import batch_progress


def crops_with_scans(crops: DataFrame, scans: DataFrame) -> DataFrame:
    """Crops with the columns of their scan; the scan's id is ``raw_scan_id``."""
    return crops.join(scans.withColumnRenamed("id", "raw_scan_id"), "raw_scan_id")


def candidates_with_batch(candidates: DataFrame, crops: DataFrame, scans: DataFrame) -> DataFrame:
    """Candidate pairs with the batch of their first crop as ``batch_id``."""
    owners = crops_with_scans(
        crops.select("id", "raw_scan_id"), scans.select("id", "batch_id")
    ).select(F.col("id").alias("card_crop_id_a"), "batch_id")
    return candidates.join(owners, "card_crop_id_a")


def _needs_rotation() -> Column:
    return (F.col("status") == "cropped") & F.col("rotation_confirmed_at").isNull()


def batch_counts(
    batches: DataFrame, scans: DataFrame, crops: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Counts of every batch; zero, not NULL, where it has nothing.

    ``pending_scans`` is added to the reported counts for the status rule.
    """
    status = F.col("status")
    confirmed = crops.select(
        F.col("raw_scan_id").alias("id"), "rotation_confirmed_at", F.lit(True).alias("has_crop")
    )
    of_scans = (
        scans.select("id", "batch_id", "status")
        .join(confirmed, "id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.count_if(status == "pending").alias("pending_scans"),
            F.count_if(status == "cropped").alias("cropped"),
            F.count_if(status == "crop_failed").alias("crop_failed"),
            F.count_if(F.col("has_crop") & _needs_rotation()).alias("pending_rotation"),
        )
    )
    pending = candidates.filter(status == "pending").select("card_crop_id_a")
    of_pairs = (
        candidates_with_batch(pending, crops, scans)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("pending_duplicate_review"))
    )
    joined = (
        batches.withColumnRenamed("id", "batch_id")
        .join(of_scans, "batch_id", "left")
        .join(of_pairs, "batch_id", "left")
    )
    counts = [
        "scans", "pending_scans", "cropped", "crop_failed", "pending_rotation", "pending_duplicate_review",
    ]
    return joined.fillna(0, counts)


def derived_status() -> Column:
    """Status of a row of ``batch_counts``: the first open stage."""
    return (
        F.when(F.col("scans") == 0, "extracting")
        .when(F.col("pending_scans") > 0, "cropping")
        .when(F.col("pending_rotation") > 0, "rotation_review")
        .when(F.col("pending_duplicate_review") > 0, "duplicate_review")
        .otherwise("complete")
    )


def batch_status(
    batches: DataFrame, scans: DataFrame, crops: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Batches with their counts, derived status and progress."""
    counted = batch_counts(batches.drop("status"), scans, crops, candidates)
    progress = batch_progress(
        F.col("status"), F.col("scans"), F.col("cropped"), F.col("crop_failed"),
        F.col("pending_rotation"), F.col("pending_duplicate_review"),
    )
    return counted.withColumn("status", derived_status()).withColumn("progress", progress)


def batches_by_status(batches: DataFrame) -> DataFrame:
    return batches.groupBy("status").agg(F.count(F.lit(1)).alias("batches"))


def rotation_queue(crops: DataFrame, scans: DataFrame) -> DataFrame:
    """Crops whose rotation waits for a reviewer."""
    waiting = crops.filter(F.col("rotation_confirmed_at").isNull())
    return crops_with_scans(waiting, scans.filter(F.col("status") == "cropped"))


def queue_depths(crops: DataFrame, scans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Length of both review queues."""
    rotation = rotation_queue(crops, scans).agg(F.count(F.lit(1)).alias("depth"))
    pairs = candidates.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("depth"))
    return rotation.withColumn("queue", F.lit("rotation")).unionByName(
        pairs.withColumn("queue", F.lit("duplicates"))
    )


def unique_and_duplicate(scans_listed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per batch: scans that are no duplicate, and confirmed pairs.

    ``scans_listed`` has ``batch_id`` and ``is_duplicate``; ``pairs`` has
    ``batch_id`` and ``status``.
    """
    unique = scans_listed.groupBy("batch_id").agg(
        F.count_if(~F.col("is_duplicate")).alias("unique_scans")
    )
    confirmed = pairs.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "confirmed_duplicate").alias("duplicate_pairs")
    )
    return unique.join(confirmed, "batch_id", "left").fillna(0, ["duplicate_pairs"])


def high_water_mark(crops: DataFrame) -> DataFrame:
    """Largest id that carries a hash; 0 when none does."""
    hashed = crops.filter(F.col("hash_0").isNotNull())
    return hashed.agg(F.coalesce(F.max("id"), F.lit(0)).alias("high_water"))
