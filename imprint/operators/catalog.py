"""Listings of cards, scans, batches and confirmed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.keys import public_url
from imprint.functions.numeric import finite_or_null
from imprint.functions.text import matches_search
from imprint.operators.status import candidates_with_batch, crops_with_scans

MOST_PER_PAGE = 200


def _page_size(limit: int) -> int:
    if not 0 < limit <= MOST_PER_PAGE:
        raise ValueError(f"limit must lie between 1 and {MOST_PER_PAGE}")
    return limit


def filter_cards(
    cards: DataFrame, batch_id: int | None = None, status: str | None = None, search: str | None = None
) -> DataFrame:
    """Cards that pass the filters given; a filter left out passes everything."""
    if batch_id is not None:
        cards = cards.filter(F.col("batch_id") == batch_id)
    if status is not None:
        cards = cards.filter(F.col("status") == status)
    if search:
        cards = cards.filter(matches_search(F.col("original_filename"), search))
    return cards


def card_page(cards: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest crop first."""
    return cards.orderBy(F.desc("id")).offset(offset).limit(_page_size(limit))


def newest_batches(batches: DataFrame, limit: int = 50) -> DataFrame:
    return batches.orderBy(F.desc("created_at"), F.desc("id")).limit(_page_size(limit))


def search_batches(batches: DataFrame, term: str = "", status: str = "all") -> DataFrame:
    """Batches whose label or id contains the term, in one status or in 'all'."""
    if term:
        in_label = F.lower("source_label").contains(term.lower())
        in_id = F.col("id").cast("string").contains(term)
        batches = batches.filter(F.coalesce(in_label, F.lit(False)) | in_id)
    if status != "all":
        batches = batches.filter(F.col("status") == status)
    return batches


def append_page(held: DataFrame, page: DataFrame) -> DataFrame:
    """Rows held so far plus those of the next page that are new."""
    return held.unionByName(page.join(held.select("id"), "id", "left_anti"))


def losers(
    candidates: DataFrame, crops: DataFrame, scans: DataFrame, scope: str = "owner"
) -> DataFrame:
    """Second crops of confirmed pairs, one row each.

    Under 'owner' a loser counts in the batch of the pair's first crop
    (``batch_id``, ``id``); under 'any' it counts everywhere (``id``).
    """
    confirmed = candidates.filter(F.col("status") == "confirmed_duplicate")
    if scope == "any":
        return confirmed.select(F.col("card_crop_id_b").alias("id")).distinct()
    if scope != "owner":
        raise ValueError("scope must be 'owner' or 'any'")
    pairs = confirmed.select("card_crop_id_a", "card_crop_id_b")
    owned = candidates_with_batch(pairs, crops, scans)
    return owned.select("batch_id", F.col("card_crop_id_b").alias("id")).distinct()


def without_losers(
    listed: DataFrame, candidates: DataFrame, crops: DataFrame, scans: DataFrame, scope: str = "owner"
) -> DataFrame:
    """Listed crops (``id``, ``batch_id``) that did not lose a confirmed pair."""
    lost = losers(candidates, crops, scans, scope)
    return listed.join(lost, lost.columns, "left_anti")


def scan_listing(
    scans: DataFrame, crops: DataFrame, candidates: DataFrame, url_base: str, scope: str = "owner"
) -> DataFrame:
    """Every scan with its thumbnail, rotation and duplicate flag.

    A scan without a stored image has no thumbnail, rotation 0, and is no
    duplicate.
    """
    lost = losers(candidates, crops, scans, scope).withColumnRenamed("id", "crop_id")
    lost = lost.withColumn("_lost", F.lit(True))
    images = crops.select(
        F.col("id").alias("crop_id"), "raw_scan_id", "r2_key_cropped", "rotation_degrees"
    )
    stored = F.coalesce(F.col("r2_key_cropped"), F.lit("")) != ""
    return (
        scans.withColumnRenamed("id", "raw_scan_id")
        .join(images, "raw_scan_id", "left")
        .join(lost, [c for c in lost.columns if c != "_lost"], "left")
        .select(
            F.col("raw_scan_id").alias("id"),
            "batch_id",
            "original_filename",
            "side",
            "status",
            public_url(F.col("r2_key_cropped"), url_base).alias("thumbnail_url"),
            F.when(stored, F.coalesce("rotation_degrees", F.lit(0))).otherwise(0).alias("rotation_degrees"),
            (stored & F.coalesce("_lost", F.lit(False))).alias("is_duplicate"),
        )
    )


def confirmed_pairs(
    candidates: DataFrame, crops: DataFrame, scans: DataFrame, url_base: str
) -> DataFrame:
    """Confirmed pairs with the kept and the removed crop, in candidate order.

    A pair belongs to the kept crop's batch; it is left out when the removed crop
    no longer exists.
    """
    cards = crops_with_scans(
        crops.select("id", "raw_scan_id", "r2_key_cropped", "rotation_degrees"),
        scans.select("id", "batch_id", "original_filename", "side"),
    )

    def named(role: str, key: str) -> DataFrame:
        columns = [
            F.col("original_filename").alias(f"{role}_filename"),
            F.col("side").alias(f"{role}_side"),
            public_url(F.col("r2_key_cropped"), url_base).alias(f"{role}_url"),
            F.coalesce("rotation_degrees", F.lit(0)).alias(f"{role}_rotation"),
        ]
        batch = ["batch_id"] if role == "kept" else []
        return cards.select(F.col("id").alias(key), *batch, *columns)

    confirmed = candidates.filter(F.col("status") == "confirmed_duplicate").select(
        F.col("id").alias("candidate_id"),
        "card_crop_id_a",
        "card_crop_id_b",
        finite_or_null(F.col("structural_score")).alias("structural_score"),
        finite_or_null(F.col("color_score")).alias("color_score"),
        "filename_match",
    )
    return (
        confirmed.join(named("kept", "card_crop_id_a"), "card_crop_id_a")
        .join(named("removed", "card_crop_id_b"), "card_crop_id_b")
        .orderBy("candidate_id")
    )


def pair_history(crops: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate pairs of each given crop, on whichever side it stands.

    Each pair is sent to both of its crops, which makes the OR an equi-join.
    """
    renamed = candidates.select(F.col("id").alias("candidate_id"), *[c for c in candidates.columns if c != "id"])
    by_crop = renamed.withColumn(
        "crop_id", F.explode(F.array_distinct(F.array("card_crop_id_a", "card_crop_id_b")))
    )
    return by_crop.join(crops.select(F.col("id").alias("crop_id")), "crop_id")


def shortlist(crops: DataFrame, matched: DataFrame) -> DataFrame:
    """Crops of other batches named in a search result.

    ``matched`` has ``query_batch_id`` and ``other_id``; one row per crop and
    querying batch.
    """
    named = matched.select("query_batch_id", F.col("other_id").alias("id")).distinct()
    return crops.join(named, "id").filter(F.col("batch_id") != F.col("query_batch_id"))


def full_listing(rows: DataFrame) -> DataFrame:
    """All rows by ascending id: a range-partitioned sort."""
    return rows.orderBy("id")
