"""Batch state, review queues, catalogue and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions import numeric
from imprint.operators import catalog, quality, retention, review, status
from imprint.plans import cards
from imprint.session import checkpoint_dir
from imprint.sources.tables import append_notes, read_table
from workload.intake_queries import LOSERS, natural_sql
from workload.registry import query
from workload.tables import URL_BASE, Tables

_URL = "'https://cdn.example.com/' || {key}"
_FINITE = "CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END"

_COUNTS = """
SELECT b.id AS batch_id, coalesce(s.scans, 0)::BIGINT AS scans, coalesce(s.pending_scans, 0)::BIGINT AS pending_scans,
  coalesce(s.cropped, 0)::BIGINT AS cropped, coalesce(s.crop_failed, 0)::BIGINT AS crop_failed,
  coalesce(s.pending_rotation, 0)::BIGINT AS pending_rotation,
  coalesce(p.n, 0)::BIGINT AS pending_duplicate_review
FROM batches b
LEFT JOIN (SELECT s.batch_id, count(*) AS scans, count_if(status = 'pending') AS pending_scans,
    count_if(status = 'cropped') AS cropped, count_if(status = 'crop_failed') AS crop_failed,
    count_if(status = 'cropped' AND c.id IS NOT NULL AND c.rotation_confirmed_at IS NULL) AS pending_rotation
  FROM scans s LEFT JOIN crops c ON c.raw_scan_id = s.id GROUP BY s.batch_id) s ON s.batch_id = b.id
LEFT JOIN (SELECT s.batch_id, count(*) AS n FROM pairs p JOIN crops c ON p.card_crop_id_a = c.id
  JOIN scans s ON c.raw_scan_id = s.id WHERE p.status = 'pending' GROUP BY s.batch_id) p ON p.batch_id = b.id
"""
_STATUS = f"""
SELECT *, CASE WHEN scans = 0 THEN 'extracting' WHEN pending_scans > 0 THEN 'cropping'
  WHEN pending_rotation > 0 THEN 'rotation_review' WHEN pending_duplicate_review > 0 THEN 'duplicate_review'
  ELSE 'complete' END AS status FROM ({_COUNTS})
"""
_COUNT_NAMES = ["scans", "cropped", "crop_failed", "pending_rotation", "pending_duplicate_review"]
_CARDS = """
SELECT c.*, s.batch_id, s.original_filename, s.pairing_key, s.side, s.status FROM crops c JOIN scans s ON c.raw_scan_id = s.id
"""
_SIDES = f"""
SELECT batch_id, pairing_key, min(CASE WHEN side = 'front' THEN id END) AS front_id,
  min(CASE WHEN side = 'back' THEN id END) AS back_id FROM ({_CARDS}) GROUP BY batch_id, pairing_key
"""


def _all(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return t.batches, t.scans, t.crops, t.candidates


def _cards(t: Tables) -> DataFrame:
    return status.crops_with_scans(t.crops, t.scans)


@query("A1", f"SELECT batch_id, {', '.join(_COUNT_NAMES)} FROM ({_COUNTS})", "batches scans crops pairs")
def batch_counts(t: Tables) -> DataFrame:
    return status.batch_counts(*_all(t)).select("batch_id", *_COUNT_NAMES)


@query(
    "A2 P13",
    f"""SELECT batch_id, status, CASE WHEN status = 'complete' THEN 100
    WHEN status = 'duplicate_review' THEN CASE WHEN pending_duplicate_review = 0 THEN 98 ELSE 80 END
    WHEN status = 'rotation_review' THEN CASE WHEN cropped <= 0 THEN 60 ELSE floor(60 + (cropped - pending_rotation) / cropped * 20 + 0.5) END
    WHEN status = 'cropping' AND scans > 0 THEN floor(20 + (cropped + crop_failed) / scans * 40 + 0.5)
    ELSE 20 END::BIGINT AS progress FROM ({_STATUS})""",
    "batches scans crops pairs",
)
def batch_status(t: Tables) -> DataFrame:
    return status.batch_status(*_all(t)).select("batch_id", "status", "progress")


@query(
    "A3",
    f"SELECT status, count(*)::BIGINT AS batches FROM ({_STATUS}) GROUP BY status",
    "batches scans crops pairs",
)
def batches_by_status(t: Tables) -> DataFrame:
    return status.batches_by_status(status.batch_status(*_all(t)))


@query(
    "A4",
    f"""SELECT 'rotation' AS queue, count(*)::BIGINT AS depth FROM ({_CARDS}) WHERE status = 'cropped' AND rotation_confirmed_at IS NULL
    UNION ALL SELECT 'duplicates', count(*)::BIGINT FROM pairs WHERE status = 'pending'""",
    "scans crops pairs",
)
def queue_depths(t: Tables) -> DataFrame:
    return status.queue_depths(t.crops, t.scans, t.candidates)


_LISTED = f"""
SELECT s.id, s.batch_id, s.original_filename, s.pairing_key, s.side, s.status,
  {_URL.format(key='c.r2_key_cropped')} AS thumbnail_url,
  CASE WHEN c.r2_key_cropped IS NOT NULL THEN coalesce(c.rotation_degrees, 0) ELSE 0 END::BIGINT AS rotation_degrees,
  c.r2_key_cropped IS NOT NULL AND l.id IS NOT NULL AS is_duplicate
FROM scans s LEFT JOIN crops c ON c.raw_scan_id = s.id LEFT JOIN ({LOSERS}) l ON l.batch_id = s.batch_id AND l.id = c.id
"""


@query(
    "A9",
    f"""SELECT l.batch_id, count_if(NOT is_duplicate)::BIGINT AS unique_scans, coalesce(any_value(p.n), 0)::BIGINT AS duplicate_pairs
    FROM ({_LISTED}) l LEFT JOIN (SELECT s.batch_id, count(*) AS n FROM pairs p JOIN crops c ON p.card_crop_id_a = c.id
    JOIN scans s ON c.raw_scan_id = s.id WHERE p.status = 'confirmed_duplicate' GROUP BY s.batch_id) p ON p.batch_id = l.batch_id
    GROUP BY l.batch_id""",
    "scans crops pairs",
)
def unique_and_duplicate(t: Tables) -> DataFrame:
    listed = catalog.scan_listing(t.scans, t.crops, t.candidates, URL_BASE)
    return status.unique_and_duplicate(listed, status.candidates_with_batch(t.candidates, t.crops, t.scans))


@query("A10", "SELECT coalesce(max(id), 0) AS high_water FROM crops WHERE hash_0 IS NOT NULL", "crops")
def high_water_mark(t: Tables) -> DataFrame:
    return status.high_water_mark(t.crops)


@query(
    "J1 P11",
    f"""SELECT id, batch_id, rotation_confirmed_at IS NULL AS unconfirmed, hash_0 IS NOT NULL AS hashed,
    r2_key_cropped IS NOT NULL AS stored, status FROM ({_CARDS})""",
    "scans crops",
)
def crops_with_scans(t: Tables) -> DataFrame:
    return _cards(t).select(
        "id", "batch_id",
        F.col("rotation_confirmed_at").isNull().alias("unconfirmed"),
        F.col("hash_0").isNotNull().alias("hashed"),
        F.col("r2_key_cropped").isNotNull().alias("stored"),
        "status",
    )


@query(
    "J2 J8 P12",
    f"SELECT id, batch_id, side, status, thumbnail_url, rotation_degrees, is_duplicate FROM ({_LISTED})",
    "scans crops pairs",
)
def scan_listing(t: Tables) -> DataFrame:
    listed = catalog.scan_listing(t.scans, t.crops, t.candidates, URL_BASE)
    return listed.drop("original_filename").withColumn("rotation_degrees", F.col("rotation_degrees").cast("long"))


@query(
    "J8",
    """SELECT s.id, c.r2_key_cropped IS NOT NULL AND c.id IN (SELECT card_crop_id_b FROM pairs WHERE status = 'confirmed_duplicate')
    AS is_duplicate FROM scans s LEFT JOIN crops c ON c.raw_scan_id = s.id""",
    "scans crops pairs",
)
def scan_listing_any_batch(t: Tables) -> DataFrame:
    """Losers flagged whichever batch their pair belongs to."""
    listed = catalog.scan_listing(t.scans, t.crops, t.candidates, URL_BASE, scope="any")
    return listed.select("id", "is_duplicate")


@query(
    "J3",
    """SELECT p.id, s.batch_id, p.status FROM pairs p JOIN crops c ON p.card_crop_id_a = c.id JOIN scans s ON c.raw_scan_id = s.id""",
    "scans crops pairs",
)
def candidates_with_batch(t: Tables) -> DataFrame:
    return status.candidates_with_batch(t.candidates, t.crops, t.scans).select("id", "batch_id", "status")


@query(
    "J4 P6 O5",
    f"""SELECT p.id AS candidate_id, {_FINITE.format(x='p.structural_score')} AS structural_score,
    {_FINITE.format(x='p.color_score')} AS color_score, p.filename_match, a.batch_id, a.id AS kept_id, b.id AS removed_id,
    a.original_filename AS kept_filename, b.original_filename AS removed_filename,
    {_URL.format(key='b.r2_key_cropped')} AS removed_url, coalesce(b.rotation_degrees, 0)::BIGINT AS removed_rotation
    FROM pairs p JOIN ({_CARDS}) a ON a.id = p.card_crop_id_a JOIN ({_CARDS}) b ON b.id = p.card_crop_id_b
    WHERE p.status = 'confirmed_duplicate'""",
    "scans crops pairs",
)
def confirmed_pairs(t: Tables) -> DataFrame:
    pairs = catalog.confirmed_pairs(t.candidates, t.crops, t.scans, URL_BASE)
    return pairs.select(
        "candidate_id", "structural_score", "color_score", "filename_match", "batch_id",
        F.col("card_crop_id_a").alias("kept_id"), F.col("card_crop_id_b").alias("removed_id"),
        "kept_filename", "removed_filename", "removed_url",
        F.col("removed_rotation").cast("long").alias("removed_rotation"),
    )


@query(
    "J5",
    f"""SELECT c.id, c.batch_id, CASE WHEN c.side = 'front' THEN k.back_id ELSE k.front_id END AS sibling_id
    FROM ({_CARDS}) c JOIN ({_SIDES}) k ON c.batch_id = k.batch_id AND c.pairing_key = k.pairing_key""",
    "scans crops",
)
def siblings(t: Tables) -> DataFrame:
    return review.siblings(_cards(t)).select("id", "batch_id", "sibling_id")


@query("J6", _SIDES, "scans crops")
def card_sides(t: Tables) -> DataFrame:
    return review.card_sides(_cards(t))


@query(
    "J7",
    f"""SELECT c.batch_id, c.id FROM ({_CARDS}) c WHERE NOT EXISTS (
      SELECT 1 FROM ({LOSERS}) l WHERE l.batch_id = c.batch_id AND l.id = c.id)""",
    "scans crops pairs",
)
def without_losers(t: Tables) -> DataFrame:
    return catalog.without_losers(_cards(t), t.candidates, t.crops, t.scans).select("batch_id", "id")


@query(
    "J10",
    """SELECT c.id AS crop_id, p.id AS candidate_id, p.status FROM crops c
    JOIN pairs p ON c.id = p.card_crop_id_a OR c.id = p.card_crop_id_b""",
    "crops pairs",
)
def pair_history(t: Tables) -> DataFrame:
    return catalog.pair_history(t.crops, t.candidates).select("crop_id", "candidate_id", "status")


@query(
    "J15",
    """SELECT id, status FROM batches ORDER BY id DESC LIMIT 300""",
    "batches",
)
def append_pages(t: Tables) -> DataFrame:
    """Two overlapping pages of 200 make 300 different rows."""
    rows = t.batches.select("id", "status")
    first = catalog.card_page(rows, 200)
    return catalog.append_page(first, catalog.card_page(rows, 200, 100))


@query(
    "O1",
    "SELECT id, created_s, status FROM batches ORDER BY created_s DESC, id DESC LIMIT 50",
    "batches",
)
def newest_batches(t: Tables) -> DataFrame:
    return catalog.newest_batches(t.batches).select("id", "created_s", "status")


@query(
    "O2 P9",
    f"""SELECT id, batch_id, original_filename, side FROM ({_CARDS}) WHERE status = 'cropped' AND original_filename ILIKE '%card_99%'
    ORDER BY id DESC LIMIT 50 OFFSET 100""",
    "scans crops",
)
def card_page(t: Tables) -> DataFrame:
    found = catalog.filter_cards(_cards(t), status="cropped", search="card_99")
    return catalog.card_page(found, 50, 100).select("id", "batch_id", "original_filename", "side")


@query(
    "P8",
    """SELECT doc_id, source, lang FROM documents WHERE source ILIKE '%rc_1%' AND lang ILIKE '%E%'""",
)
def substring_search(t: Tables) -> DataFrame:
    """The underscore in the term is a wildcard."""
    from imprint.functions.text import matches_search

    rows = t.given("documents").select("doc_id", "source", "lang")
    return rows.filter(matches_search(F.col("source"), "rc_1")).filter(matches_search(F.col("lang"), "E"))


@query(
    "P9",
    f"SELECT id, batch_id FROM ({_CARDS}) WHERE batch_id = 7 AND status = 'cropped'",
    "scans crops",
)
def filter_cards(t: Tables) -> DataFrame:
    return catalog.filter_cards(_cards(t), batch_id=7, status="cropped").select("id", "batch_id")


@query(
    "P10",
    """SELECT id, source_label FROM batches WHERE (contains(lower(source_label), 'auto') OR contains(id::VARCHAR, 'Auto')) AND status = 'cropping'
    UNION ALL SELECT id, source_label FROM batches WHERE contains(lower(source_label), '42') OR contains(id::VARCHAR, '42')""",
    "batches",
)
def search_batches(t: Tables) -> DataFrame:
    columns = ["id", "source_label"]
    by_label = catalog.search_batches(t.batches, "Auto", "cropping").select(columns)
    return by_label.unionByName(catalog.search_batches(t.batches, "42").select(columns))


@query(
    "O3",
    f"""SELECT * FROM (SELECT 'first' AS cursor, id, batch_id FROM ({_CARDS}) WHERE status = 'cropped' AND rotation_confirmed_at IS NULL ORDER BY id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'after', id, batch_id FROM ({_CARDS}) WHERE status = 'cropped' AND rotation_confirmed_at IS NULL AND id > 1000 ORDER BY id LIMIT 1)""",
    "scans crops",
)
def next_in_rotation(t: Tables) -> DataFrame:
    queue = status.rotation_queue(t.crops, t.scans)
    parts = [
        review.next_in_rotation(queue, after).select(F.lit(label).alias("cursor"), "id", "batch_id")
        for label, after in (("first", None), ("after", 1000))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "O4",
    "SELECT id, card_crop_id_a, card_crop_id_b FROM pairs WHERE status = 'pending' ORDER BY id LIMIT 1",
    "pairs",
)
def next_pending_pair(t: Tables) -> DataFrame:
    return review.next_pending_pair(t.candidates).select("id", "card_crop_id_a", "card_crop_id_b")


@query("O5", "SELECT id, hash_0 FROM crops WHERE hash_0 IS NOT NULL", "crops")
def full_listing(t: Tables) -> DataFrame:
    return catalog.full_listing(t.crops.filter("hash_0 IS NOT NULL")).select("id", "hash_0")


_DECISIONS = (
    "SELECT {id} AS candidate_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) * 1000000 + l_suppkey AS seq, "
    "CASE l_returnflag WHEN 'R' THEN 'confirmed_duplicate' WHEN 'A' THEN 'rejected' ELSE 'pending' END AS status, "
    "CAST(l_suppkey % 25 AS BIGINT) AS reviewed_by, CAST(l_orderkey AS BIGINT) AS reviewed_at FROM {rows} WHERE l_orderkey <> l_partkey"
)
_DECISIONS_SQL = _DECISIONS.format(
    id="CAST(('0x' || substr(md5(concat(least(l_orderkey, l_partkey) * 2 + 1, '-', greatest(l_orderkey, l_partkey) * 2 + 1)), 1, 15)) AS BIGINT)",
    rows="lineitem",
)


def _decisions(t: Tables) -> DataFrame:
    key = "CAST(conv(substr(md5(concat(least(l_orderkey, l_partkey) * 2 + 1, '-', greatest(l_orderkey, l_partkey) * 2 + 1)), 1, 15), 16, 10) AS BIGINT)"
    return t.spark.sql(_DECISIONS.format(id=key, rows="{rows}"), rows=t.given("lineitem"))


@query(
    "P20",
    f"""SELECT candidate_id, seq, status, status IN ('confirmed_duplicate', 'rejected') AS accepted, count(*)::BIGINT AS n
    FROM ({_DECISIONS_SQL}) GROUP BY ALL""",
)
def split_decisions(t: Tables) -> DataFrame:
    accepted, rejected = review.split_decisions(_decisions(t))
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.groupBy("candidate_id", "seq", "status", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D1",
    f"""SELECT p.id, coalesce(d.status, p.status) AS status, coalesce(d.reviewed_by, p.reviewed_by) AS reviewed_by, d.reviewed_at
    FROM pairs p LEFT JOIN (SELECT candidate_id, arg_max(status, seq) AS status, arg_max(reviewed_by, seq) AS reviewed_by,
      arg_max(reviewed_at, seq) AS reviewed_at FROM ({_DECISIONS_SQL}) WHERE status IN ('confirmed_duplicate', 'rejected')
      GROUP BY candidate_id) d ON d.candidate_id = p.id""",
    "pairs",
)
def apply_decisions(t: Tables) -> DataFrame:
    pairs = t.candidates.withColumn("reviewed_at", F.lit(None).cast("long"))
    decided = review.apply_decisions(pairs, _decisions(t))
    return decided.select("id", "status", "reviewed_by", "reviewed_at")


@query(
    "P7",
    """SELECT event_id, CASE WHEN d % 360 IN (90, 180, 270) THEN d % 360 WHEN (d % 360 + 360) % 360 IN (90, 180, 270) THEN (d % 360 + 360) % 360 END::BIGINT AS turn,
    (((event_id % 4) * 90 + d) % 360 + 360) % 360 AS turned FROM (SELECT event_id, (event_id % 17 - 8) * 45 AS d FROM events)""",
)
def rotation_arithmetic(t: Tables) -> DataFrame:
    degrees = (F.col("event_id") % 17 - 8) * 45
    return t.given("events").select(
        "event_id",
        numeric.quarter_turn(degrees).cast("long").alias("turn"),
        numeric.turn((F.col("event_id") % 4) * 90, degrees).cast("long").alias("turned"),
    )


@query(
    "D2",
    """SELECT c.id, ((coalesce(c.rotation_degrees, 0) + coalesce(r.total, 0)) % 360)::BIGINT AS rotation_degrees FROM crops c
    LEFT JOIN (SELECT l_orderkey * 2 + 1 AS id, sum((l_linenumber * 45) % 360) AS total FROM lineitem
      WHERE (l_linenumber * 45) % 360 IN (90, 180, 270) GROUP BY 1) r ON r.id = c.id""",
    "crops",
)
def apply_rotations(t: Tables) -> DataFrame:
    """One request of a multiple of 45 degrees per line item."""
    requests = t.given("lineitem").selectExpr("l_orderkey * 2 + 1 AS crop_id", "l_linenumber * 45 AS degrees")
    turned = review.apply_rotations(t.crops, requests)
    return turned.select("id", F.col("rotation_degrees").cast("long").alias("rotation_degrees"))


@query(
    "D3",
    """SELECT c.id, epoch(coalesce(l.at, c.rotation_confirmed_at))::BIGINT AS confirmed_s FROM crops c
    LEFT JOIN (SELECT l_orderkey * 2 + 1 AS id, max(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.id = c.id""",
    "crops",
)
def apply_confirmations(t: Tables) -> DataFrame:
    confirmations = t.given("lineitem").filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey * 2 + 1 AS crop_id", "l_shipdate AS confirmed_at"
    )
    stamped = review.apply_confirmations(t.crops, confirmations)
    return stamped.select("id", F.unix_timestamp(F.col("rotation_confirmed_at").cast("timestamp")).alias("confirmed_s"))


@query(
    "D4",
    f"""SELECT 'scan' AS part, s.id, CASE WHEN s.status = 'pending' AND b.status = 'cropping' THEN 'crop_failed' ELSE s.status END AS status
    FROM scans s JOIN ({_STATUS}) b ON b.batch_id = s.batch_id
    UNION ALL SELECT 'rejected', batch_id, status FROM ({_STATUS}) WHERE status <> 'cropping'""",
    "batches scans crops pairs",
)
def force_advance(t: Tables) -> DataFrame:
    """Requested for every batch."""
    requested = t.batches.select(F.col("id").alias("batch_id"))
    moved, rejected = review.force_advance(*_all(t), requested)
    return moved.select(F.lit("scan").alias("part"), "id", "status").unionByName(
        rejected.select(F.lit("rejected").alias("part"), F.col("batch_id").alias("id"), F.col("batch_status").alias("status"))
    )


_DOOMED = "SELECT * FROM batches WHERE status = 'complete'"
_GONE = f"SELECT c.id FROM ({_CARDS}) c JOIN ({_DOOMED}) d ON d.id = c.batch_id"


@query(
    "D5",
    f"""SELECT 'batches' AS part, id FROM batches WHERE status <> 'complete'
    UNION ALL SELECT 'scans', s.id FROM scans s WHERE s.batch_id NOT IN (SELECT id FROM ({_DOOMED}))
    UNION ALL SELECT 'crops', id FROM crops WHERE id NOT IN ({_GONE})
    UNION ALL SELECT 'candidates', id FROM pairs WHERE card_crop_id_a NOT IN ({_GONE}) AND card_crop_id_b NOT IN ({_GONE})""",
    "batches scans crops pairs",
)
def cascade_delete(t: Tables) -> DataFrame:
    left = retention.cascade_delete(t.batches.filter("status = 'complete'"), *_all(t))
    parts = [
        getattr(left, name).select(F.lit(name).alias("part"), "id")
        for name in ("batches", "scans", "crops", "candidates")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_KEYS = """
SELECT id AS batch_id, concat('tmp/uploads/', id, '.zip') AS key FROM batches
UNION ALL SELECT batch_id, r2_key_raw FROM scans
UNION ALL SELECT s.batch_id, c.r2_key_cropped FROM crops c JOIN scans s ON c.raw_scan_id = s.id WHERE c.r2_key_cropped IS NOT NULL
"""


@query("U2", _KEYS, "batches scans crops")
def storage_keys(t: Tables) -> DataFrame:
    return retention.storage_keys(t.batches, t.scans, t.crops)


@query(
    "A8",
    f"""SELECT batch_id, count_if(NOT failed)::BIGINT AS keys_deleted, count_if(failed)::BIGINT AS keys_failed,
    string_agg(CASE WHEN failed THEN key || ': timeout' END, '; ' ORDER BY key) AS notes,
    ceil(count_if(failed) / 1000)::BIGINT AS note_parts
    FROM (SELECT *, contains(key, '7-') AS failed FROM ({_KEYS})) GROUP BY batch_id""",
    "batches scans crops",
)
def deletion_accounting(t: Tables) -> DataFrame:
    return retention.deletion_accounting(_removals(t))


def _removals(t: Tables) -> DataFrame:
    error = F.when(F.contains(F.col("key"), F.lit("7-")), "timeout")
    return retention.storage_keys(t.batches, t.scans, t.crops).withColumn("error", error)


@query(
    "A8 S10",
    f"""SELECT batch_id % 5 AS batch_id, note_parts, part, string_agg(key || ': timeout', '; ' ORDER BY key || ': timeout') AS notes FROM (
      SELECT k.batch_id, k.key, n.note_parts, ('0x' || substr(md5(k.key), 1, 8))::BIGINT % n.note_parts AS part
      FROM (SELECT batch_id % 5 AS batch_id, key FROM ({_KEYS}) WHERE contains(key, '7-')) k
      JOIN (SELECT batch_id % 5 AS batch_id, ceil(count(*) / 1000)::BIGINT AS note_parts FROM ({_KEYS}) WHERE contains(key, '7-') GROUP BY 1) n
        ON n.batch_id = k.batch_id) GROUP BY ALL""",
    "batches scans crops",
)
def failure_notes(t: Tables) -> DataFrame:
    """All removals in five batches, so that notes take several parts; written to and read from the audit notes."""
    root = f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"
    five = _removals(t).withColumn("batch_id", F.col("batch_id") % 5)
    append_notes(retention.failure_notes(five), root)
    return read_table(t.spark, root, "audit_notes").select("batch_id", "note_parts", "part", "notes")


@query(
    "P14",
    """SELECT o_orderkey, CASE WHEN total <= 0 THEN 0 ELSE least(100, floor(value / total * 100 + 0.5)) END::BIGINT AS percent
    FROM (SELECT o_orderkey, o_orderkey % 200 AS value, o_custkey % 150 AS total FROM orders)""",
)
def percent(t: Tables) -> DataFrame:
    share = numeric.percent(F.col("o_orderkey") % 200, F.col("o_custkey") % 150)
    return t.given("orders").select("o_orderkey", share.alias("percent"))


@query(
    "P6",
    f"SELECT id, {_FINITE.format(x='structural_score')} AS structural, {_FINITE.format(x='color_score')} AS color FROM pairs",
    "pairs",
)
def finite_scores(t: Tables) -> DataFrame:
    return t.candidates.select(
        "id",
        numeric.finite_or_null(F.col("structural_score")).alias("structural"),
        numeric.finite_or_null(F.col("color_score")).alias("color"),
    )


@query(
    "P16",
    """SELECT id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT id, coalesce((s + c) / 2, s, c) AS score FROM (
      SELECT id, CASE WHEN NOT isnan(structural_score) THEN 1 - structural_score / 64 END AS s,
      CASE WHEN NOT isinf(color_score) THEN 1 - color_score END AS c FROM pairs))""",
    "pairs",
)
def confidence_bands(t: Tables) -> DataFrame:
    structural = numeric.structural_similarity(numeric.finite_or_null(F.col("structural_score")))
    color = numeric.color_similarity(numeric.finite_or_null(F.col("color_score")))
    return t.candidates.select("id", numeric.confidence(structural, color).alias("confidence"))


@query(
    "M5",
    """SELECT p.id, a.pairing_key = b.pairing_key AS filename_match FROM pairs p
    JOIN crops ca ON ca.id = p.card_crop_id_a JOIN scans a ON a.id = ca.raw_scan_id
    JOIN crops cb ON cb.id = p.card_crop_id_b JOIN scans b ON b.id = cb.raw_scan_id""",
    "scans crops pairs",
)
def filename_match(t: Tables) -> DataFrame:
    from imprint.functions.naming import pairing_key

    keys = _cards(t).select("id", pairing_key(F.col("original_filename")).alias("key"))
    pairs = t.candidates.select("id", "card_crop_id_a", "card_crop_id_b")
    for side in ("a", "b"):
        pairs = pairs.join(keys.select(F.col("id").alias(f"card_crop_id_{side}"), F.col("key").alias(f"key_{side}")), f"card_crop_id_{side}")
    return pairs.select("id", (F.col("key_a") == F.col("key_b")).alias("filename_match"))


@query(
    "P15",
    """SELECT 'scan_side' AS rule, id::VARCHAR AS key FROM s WHERE side NOT IN ('front', 'back')
    UNION ALL SELECT 'scan_status', id::VARCHAR FROM s WHERE status NOT IN ('pending', 'cropped', 'crop_failed')
    UNION ALL SELECT 'scan_key_missing', id::VARCHAR FROM s WHERE r2_key_raw IS NULL
    UNION ALL SELECT 'crop_scan_unique', raw_scan_id::VARCHAR FROM c GROUP BY raw_scan_id HAVING count(*) > 1
    UNION ALL SELECT 'crop_without_scan', id::VARCHAR FROM c WHERE raw_scan_id NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'pair_without_first', id::VARCHAR FROM pairs WHERE card_crop_id_a NOT IN (SELECT id FROM c)
    UNION ALL SELECT 'pair_without_second', id::VARCHAR FROM pairs WHERE card_crop_id_b NOT IN (SELECT id FROM c)
    UNION ALL SELECT 'user_name_unique', n_name FROM nation GROUP BY n_name HAVING count(*) > 1""".replace(
        " FROM s ", " FROM (SELECT id, batch_id, CASE WHEN id % 501 = 0 THEN 'top' ELSE side END AS side, CASE WHEN id % 502 = 0 THEN 'lost' ELSE status END AS status, CASE WHEN id % 503 <> 0 THEN r2_key_raw END AS r2_key_raw FROM scans) "
    ).replace("FROM s)", "FROM scans)").replace(
        " FROM c ", " FROM (SELECT id, CASE WHEN id % 505 = 0 THEN -id ELSE raw_scan_id // 2 END AS raw_scan_id FROM crops) "
    ).replace("FROM c)", "FROM crops)"),
    "batches scans crops pairs",
)
def constraint_audit(t: Tables) -> DataFrame:
    """Over tables with faults written into them."""
    scans = t.scans.withColumns(
        {
            "side": F.expr("CASE WHEN id % 501 = 0 THEN 'top' ELSE side END"),
            "status": F.expr("CASE WHEN id % 502 = 0 THEN 'lost' ELSE status END"),
            "r2_key_raw": F.expr("CASE WHEN id % 503 <> 0 THEN r2_key_raw END"),
        }
    )
    crops = t.crops.withColumn("raw_scan_id", F.expr("CASE WHEN id % 505 = 0 THEN -id ELSE raw_scan_id div 2 END"))
    return quality.constraint_audit(t.batches, scans, crops, t.candidates, t.users)


@query(
    "C3",
    f"""SELECT c.id, c.batch_id, c.side, c.status, {_URL.format(key='c.r2_key_cropped')} AS image_url,
    {_URL.format(key='f.r2_key_cropped')} AS front_image_url, {_URL.format(key='b.r2_key_cropped')} AS back_image_url
    FROM ({_CARDS}) c JOIN ({_SIDES}) k ON k.batch_id = c.batch_id AND k.pairing_key = c.pairing_key
    LEFT JOIN crops f ON f.id = CASE WHEN c.side = 'front' THEN c.id ELSE k.front_id END
    LEFT JOIN crops b ON b.id = CASE WHEN c.side = 'back' THEN c.id ELSE k.back_id END""",
    "scans crops",
)
def card_detail(t: Tables) -> DataFrame:
    detail, _ = cards.card_detail(t.crops, t.crops, t.scans, t.candidates, URL_BASE)
    return detail.select("id", "batch_id", "side", "status", "image_url", "front_image_url", "back_image_url")


_CARD_ROWS = f"""
SELECT c.id, c.batch_id, c.original_filename, c.side, {_URL.format(key='c.r2_key_cropped')} AS image_url,
  {_URL.format(key='f.r2_key_cropped')} AS front_image_url, {_URL.format(key='b.r2_key_cropped')} AS back_image_url
FROM ({_CARDS}) c JOIN ({_SIDES}) k ON k.batch_id = c.batch_id AND k.pairing_key = c.pairing_key
LEFT JOIN crops f ON f.id = CASE WHEN c.side = 'front' THEN c.id ELSE k.front_id END
LEFT JOIN crops b ON b.id = CASE WHEN c.side = 'back' THEN c.id ELSE k.back_id END
"""
_ENDS = ", ".join(
    f"{e}.{c} AS {e}_{c}" for e in "ab" for c in ("batch_id", "original_filename", "side", "image_url", "front_image_url", "back_image_url")
)


@query(
    "C3 J10 P6",
    f"""SELECT c.id AS crop_id, p.id AS candidate_id, {_FINITE.format(x='p.structural_score')} AS structural_score,
    {_FINITE.format(x='p.color_score')} AS color_score, p.filename_match, {_ENDS} FROM crops c
    JOIN (SELECT *, card_crop_id_a AS place FROM pairs UNION ALL SELECT *, card_crop_id_b FROM pairs) p ON p.place = c.id
    LEFT JOIN ({_CARD_ROWS}) a ON a.id = p.card_crop_id_a LEFT JOIN ({_CARD_ROWS}) b ON b.id = p.card_crop_id_b""",
    "scans crops pairs",
)
def card_duplicate_history(t: Tables) -> DataFrame:
    _, history = cards.card_detail(t.crops, t.crops, t.scans, t.candidates, URL_BASE)
    ends = [c for c in history.columns if c[:2] in ("a_", "b_")]
    return history.select("crop_id", "candidate_id", "structural_score", "color_score", "filename_match", *ends)


@query(
    "C4",
    f"""SELECT id, batch_id, side, status, thumbnail_url, rotation_degrees, is_duplicate,
    array_to_string({natural_sql('pairing_key', 'side')}, '~') AS sort_key FROM ({_LISTED})""",
    "scans crops pairs",
)
def batch_listing(t: Tables) -> DataFrame:
    listed = cards.batch_listing(t.batches, t.scans, t.crops, t.candidates, URL_BASE)
    return listed.drop("original_filename").withColumns(
        {"rotation_degrees": F.col("rotation_degrees").cast("long"), "sort_key": F.array_join("sort_key", "~")}
    )
