"""Review queues and the decisions taken in them, as table to table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.numeric import quarter_turn, turn
from imprint.operators.status import batch_counts, derived_status
from imprint.schemas import DECISIONS


def card_sides(listed: DataFrame) -> DataFrame:
    """First front and first back crop of every card of a batch.

    ``listed`` has ``id``, ``batch_id``, ``pairing_key`` and ``side``. One row per
    card; a missing side is NULL.
    """

    def least(side: str):
        return F.min(F.when(F.col("side") == side, F.col("id")))

    return listed.groupBy("batch_id", "pairing_key").agg(
        least("front").alias("front_id"), least("back").alias("back_id")
    )


def siblings(listed: DataFrame) -> DataFrame:
    """Each crop with the smallest crop id of its card's other side, or NULL.

    The other side is looked up in one row per card; sides are never paired off
    against each other, so a key shared by very many scans stays linear.
    """
    other = F.when(F.col("side") == "front", F.col("back_id")).otherwise(F.col("front_id"))
    return (
        listed.join(card_sides(listed), ["batch_id", "pairing_key"], "left")
        .withColumn("sibling_id", other)
        .drop("front_id", "back_id")
    )


def next_in_rotation(queue: DataFrame, after_id: int | None = None, batch_id: int | None = None) -> DataFrame:
    """Waiting crop with the smallest id behind the cursor."""
    if batch_id is not None:
        queue = queue.filter(F.col("batch_id") == batch_id)
    if after_id is not None:
        queue = queue.filter(F.col("id") > after_id)
    return queue.orderBy("id").limit(1)


def next_pending_pair(candidates: DataFrame) -> DataFrame:
    """Head of the duplicate queue, over all batches."""
    return candidates.filter(F.col("status") == "pending").orderBy("id").limit(1)


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) decision rows; only two statuses may be decided."""
    valid = F.coalesce(F.col("status").isin(DECISIONS), F.lit(False))
    return decisions.filter(valid), decisions.filter(~valid)


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after the decisions; the last one for a pair holds.

    ``decisions`` has ``candidate_id``, ``seq``, ``status``, ``reviewed_by`` and
    ``reviewed_at``. Of decisions with the same ``seq`` the latest holds, then the one
    whose status and reviewer come last.
    """
    accepted, _ = split_decisions(decisions)
    decided = ["status", "reviewed_by", "reviewed_at"]
    last = accepted.groupBy(F.col("candidate_id").alias("id")).agg(
        F.max(F.struct("seq", "reviewed_at", "status", "reviewed_by")).alias("_last")
    )
    changed = {c: F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)) for c in decided}
    return candidates.join(last, "id", "left").withColumns(changed).drop("_last")


def apply_rotations(crops: DataFrame, requests: DataFrame) -> DataFrame:
    """Crops turned by the sum of their accepted quarter turns.

    ``requests`` has ``crop_id`` and ``degrees``.
    """
    turns = (
        requests.select(F.col("crop_id").alias("id"), quarter_turn(F.col("degrees")).alias("_turn"))
        .filter(F.col("_turn").isNotNull())
        .groupBy("id")
        .agg(F.sum("_turn").alias("_turn"))
    )
    turned = turn(F.col("rotation_degrees"), F.coalesce("_turn", F.lit(0))).cast("int")
    return crops.join(turns, "id", "left").withColumn("rotation_degrees", turned).drop("_turn")


def apply_confirmations(crops: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Crops stamped with their latest confirmation (``crop_id``, ``confirmed_at``)."""
    latest = confirmations.groupBy(F.col("crop_id").alias("id")).agg(
        F.max("confirmed_at").alias("_at")
    )
    stamped = F.coalesce("_at", "rotation_confirmed_at")
    return crops.join(latest, "id", "left").withColumn("rotation_confirmed_at", stamped).drop("_at")


def force_advance(
    batches: DataFrame,
    scans: DataFrame,
    crops: DataFrame,
    candidates: DataFrame,
    requested: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(scans, rejected): fail the pending scans of requested batches.

    Only a batch in the cropping state may be advanced; ``rejected`` lists the
    other requests (``batch_id``) with their status.
    """
    asked = requested.select("batch_id").distinct()
    status = (
        batch_counts(batches.drop("status"), scans, crops, candidates)
        .join(asked, "batch_id", "left_semi")
        .select("batch_id", derived_status().alias("batch_status"))
    )
    advanced = status.filter(F.col("batch_status") == "cropping").select(
        "batch_id", F.lit(True).alias("_advance")
    )
    failed = F.when(F.col("_advance") & (F.col("status") == "pending"), "crop_failed").otherwise(
        F.col("status")
    )
    moved = scans.join(advanced, "batch_id", "left").withColumn("status", failed).drop("_advance")
    return moved, status.filter(F.col("batch_status") != "cropping")
