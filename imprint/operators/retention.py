"""Deleting batches with everything that hangs on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.keys import upload_key
from imprint.session import materialize

NOTES_PER_PART = 1000
#: Ids that may be sent to every task to leave rows out.
SENT_IDS = 1_000_000


@dataclass(frozen=True)
class Remaining:
    """The tables after a deletion."""

    batches: DataFrame
    scans: DataFrame
    crops: DataFrame
    candidates: DataFrame


def storage_keys(batches: DataFrame, scans: DataFrame, crops: DataFrame) -> DataFrame:
    """Every stored object of the given batches: upload, raw and cropped images."""
    ids = batches.select(F.col("id").alias("batch_id"))
    owned = scans.join(ids, "batch_id", "left_semi")
    uploads = ids.select("batch_id", upload_key(F.col("batch_id")).alias("key"))
    raw = owned.select("batch_id", F.col("r2_key_raw").alias("key"))
    cropped = crops.select("raw_scan_id", F.col("r2_key_cropped").alias("key")).join(
        owned.select(F.col("id").alias("raw_scan_id"), "batch_id"), "raw_scan_id"
    )
    stored = uploads.unionByName(raw).unionByName(cropped.select("batch_id", "key"))
    return stored.filter(F.col("key").isNotNull() & (F.col("key") != ""))


def cascade_delete(
    doomed: DataFrame, batches: DataFrame, scans: DataFrame, crops: DataFrame, candidates: DataFrame
) -> Remaining:
    """Tables without the ``doomed`` batches (``id``).

    A candidate pair goes when either of its crops goes. The ids that go are found
    once and written; where they are few they are sent to the tables, which then stay
    in place.
    """
    gone_batches = doomed.select("id").distinct()
    gone_scans = _gone(scans.join(gone_batches.withColumnRenamed("id", "batch_id"), "batch_id", "left_semi"))
    gone_crops = _gone(crops.join(gone_scans.withColumnRenamed("id", "raw_scan_id"), "raw_scan_id", "left_semi"))
    kept_pairs = candidates
    for side in ("card_crop_id_a", "card_crop_id_b"):
        kept_pairs = kept_pairs.join(gone_crops.withColumnRenamed("id", side), side, "left_anti")
    return Remaining(
        batches=batches.join(gone_batches, "id", "left_anti"),
        scans=scans.join(gone_scans, "id", "left_anti"),
        crops=crops.join(gone_crops, "id", "left_anti"),
        candidates=kept_pairs.select(candidates.columns),
    )


def _gone(rows: DataFrame) -> DataFrame:
    ids = materialize(rows.select("id"))
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def failure_notes(removals: DataFrame) -> DataFrame:
    """Failed removals joined to text with '; ', in numbered parts per batch.

    ``removals`` has ``batch_id``, ``key`` and ``error`` (NULL on success). Notes
    are spread over as many parts as keep each near a thousand entries, so that
    a batch whose every removal failed is still written whole.
    """
    failed = removals.filter(F.col("error").isNotNull())
    parts = failed.groupBy("batch_id").agg(
        F.ceil(F.count(F.lit(1)) / NOTES_PER_PART).alias("note_parts")
    )
    note = F.concat("key", F.lit(": "), "error")
    part = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint") % F.col("note_parts")
    return (
        failed.join(parts, "batch_id")
        .groupBy("batch_id", "note_parts", part.alias("part"))
        .agg(F.concat_ws("; ", F.array_sort(F.collect_list(note))).alias("notes"))
    )


def deletion_accounting(removals: DataFrame) -> DataFrame:
    """Keys deleted and failed per batch, with the failure notes.

    ``notes`` holds the whole text of a batch's failures by key, however many, and is
    NULL without any. ``note_parts`` says how many rows of ``failure_notes`` hold
    the same text in pieces.
    """
    note = F.concat("key", F.lit(": "), "error")
    keyed = F.when(note.isNotNull(), F.struct("key", note.alias("note")))
    return removals.groupBy("batch_id").agg(
        F.count_if(F.col("error").isNull()).alias("keys_deleted"),
        F.count_if(F.col("error").isNotNull()).alias("keys_failed"),
        F.array_sort(F.collect_list(keyed)).alias("_notes"),
    ).select(
        "batch_id", "keys_deleted", "keys_failed",
        F.when(F.size("_notes") > 0, F.array_join(F.col("_notes.note"), "; ")).alias("notes"),
        F.ceil(F.col("keys_failed") / NOTES_PER_PART).alias("note_parts"),
    )


def audit_rows(
    doomed: DataFrame, scans: DataFrame, removals: DataFrame, performed_by: int | None = None
) -> DataFrame:
    """One audit row per deleted batch, taken before the rows go; its notes are rows of ``failure_notes``.

    ``doomed`` has ``id``, ``source_label`` and ``status``.
    """
    ids = doomed.select(
        F.col("id").alias("batch_id"), "source_label", F.col("status").alias("batch_status")
    )
    scan_counts = scans.groupBy("batch_id").agg(F.count(F.lit(1)).alias("scan_count"))
    return (
        ids.join(scan_counts, "batch_id", "left")
        .join(deletion_accounting(removals).drop("notes"), "batch_id", "left")
        .fillna(0, ["scan_count", "keys_deleted", "keys_failed", "note_parts"])
        .withColumns(
            {
                "action": F.lit("hard_delete"),
                "performed_by": F.lit(performed_by).cast("long"),
                "performed_at": F.current_timestamp(),
            }
        )
    )
