"""Schemas and vocabularies of the pipeline tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies stored in the tables.
BATCH_STATUSES = ["extracting", "cropping", "rotation_review", "duplicate_review", "complete"]
SCAN_STATUSES = ["pending", "cropped", "crop_failed"]
SIDES = ["front", "back"]
CANDIDATE_STATUSES = ["pending", "confirmed_duplicate", "rejected"]
DECISIONS = ["confirmed_duplicate", "rejected"]
ROTATIONS = [0, 90, 180, 270]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png"]
AUTOMATED_STAGES = [
    "extracting",
    "cropping",
    "zip_extraction",
    "hashing",
    "duplicate_detection",
]

PRINT = T.StructType(
    [
        T.StructField("rotation", T.IntegerType()),
        T.StructField("hash", T.LongType()),
        T.StructField("color", T.ArrayType(T.FloatType())),
    ]
)

BOX = T.StructType(
    [
        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("aspect_ratio", T.DoubleType()),
        T.StructField("orientation", T.StringType()),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("source_label", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

RAW_SCANS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("batch_id", T.LongType()),
        T.StructField("r2_key_raw", T.StringType()),
        T.StructField("original_filename", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

CARD_CROPS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("raw_scan_id", T.LongType()),
        T.StructField("r2_key_cropped", T.StringType()),
        T.StructField("crop_bbox", BOX),
        T.StructField("aspect_ratio_ok", T.BooleanType()),
        T.StructField("rotation_degrees", T.IntegerType()),
        T.StructField("rotation_confirmed_at", T.TimestampType()),
        T.StructField("prints", T.ArrayType(PRINT)),
    ]
)

CANDIDATES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("card_crop_id_a", T.LongType()),
        T.StructField("card_crop_id_b", T.LongType()),
        T.StructField("structural_score", T.DoubleType()),
        T.StructField("color_score", T.DoubleType()),
        T.StructField("filename_match", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("reviewed_by", T.LongType()),
        T.StructField("reviewed_at", T.TimestampType()),
    ]
)

AUDIT_LOG = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("performed_by", T.LongType()),
        T.StructField("performed_at", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("source_label", T.StringType()),
        T.StructField("batch_status", T.StringType()),
        T.StructField("scan_count", T.LongType()),
        T.StructField("keys_deleted", T.LongType()),
        T.StructField("keys_failed", T.LongType()),
        T.StructField("note_parts", T.LongType()),
    ]
)

AUDIT_NOTES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("note_parts", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("notes", T.StringType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

STAGE_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

LOG_LINE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("processing_stage", T.StringType()),
        T.StructField("image_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("queue_wait_ms", T.LongType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("exception_type", T.StringType()),
        T.StructField("exception_message", T.StringType()),
        T.StructField("stack_trace", T.StringType()),
    ]
)

TABLES = {
    "batches": BATCHES,
    "raw_scans": RAW_SCANS,
    "card_crops": CARD_CROPS,
    "candidates": CANDIDATES,
    "audit_log": AUDIT_LOG,
    "audit_notes": AUDIT_NOTES,
    "audit_notes": AUDIT_NOTES,
    "users": USERS,
    "stage_events": STAGE_EVENTS,
}
