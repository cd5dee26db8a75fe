"""Archive entries: classification, first-wins repeats and the intake summary.

An *entry row* has ``archive``, ``ordinal`` (position in the archive), ``path``
and ``size``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions import naming
from imprint.functions.keys import raw_key
from imprint.schemas import IMAGE_EXTENSIONS


def name_entries(entries: DataFrame) -> DataFrame:
    """Add file name, extension, side and pairing key."""
    name = F.col("name")
    return entries.withColumn("name", naming.basename(F.col("path"))).withColumns(
        {
            "ext": naming.extension(name),
            "side": naming.parse_side(name),
            "pairing_key": naming.pairing_key(name),
        }
    )


def first_entries(entries: DataFrame) -> DataFrame:
    """(archive, ordinal) of the first entry of each (archive, name, side).

    Only entries that pass the extension and naming rules compete. Built with a
    partial aggregate, so a name repeated very often costs little.
    """
    return (
        entries.filter(F.col("ext").isin(IMAGE_EXTENSIONS) & F.col("side").isNotNull())
        .groupBy("archive", F.lower("name"), "side")
        .agg(F.min("ordinal").alias("ordinal"))
        .select("archive", "ordinal")
    )


def classify_entries(entries: DataFrame) -> DataFrame:
    """Add ``outcome``: unsupported, unmatched_naming, duplicate or supported.

    Firsts are looked up by position, a key without skew.
    """
    named = name_entries(entries)
    firsts = first_entries(named).withColumn("_first", F.lit(True))
    outcome = (
        F.when(F.col("ext").isNull() | ~F.col("ext").isin(IMAGE_EXTENSIONS), "unsupported")
        .when(F.col("side").isNull(), "unmatched_naming")
        .when(F.col("_first").isNull(), "duplicate")
        .otherwise("supported")
    )
    return (
        named.join(firsts, ["archive", "ordinal"], "left")
        .withColumn("outcome", outcome)
        .drop("_first")
    )


def supported_scans(classified: DataFrame, scan_id: str = "scan_id") -> DataFrame:
    """Pending scan rows for the entries that are kept.

    ``classified`` carries the batch id as ``archive`` and an id per entry.
    """
    return classified.filter(F.col("outcome") == "supported").select(
        F.col(scan_id).alias("id"),
        F.col("archive").alias("batch_id"),
        raw_key(F.col("archive"), F.col(scan_id), F.col("side"), F.col("ext")).alias("r2_key_raw"),
        F.col("name").alias("original_filename"),
        "pairing_key",
        "side",
        F.lit("pending").alias("status"),
    )


def intake_summary(classified: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """Counts and uncompressed bytes per archive, over all its entries.

    ``archives`` (archive, compressed_size) adds the compressed bytes, and rows
    for archives without entries.
    """
    outcome = F.col("outcome")
    summary = classified.groupBy("archive").agg(
        F.count_if(outcome == "supported").alias("supported_images"),
        F.count_if(outcome == "unsupported").alias("unsupported_files"),
        F.count_if(outcome == "unmatched_naming").alias("unmatched_naming"),
        F.count_if(outcome == "duplicate").alias("duplicate_entries"),
        F.sum("size").alias("uncompressed_size"),
    )
    if archives is None:
        return summary
    counts = [c for c in summary.columns if c != "archive"]
    return archives.join(summary, "archive", "left").fillna(0, counts)


def backfill_pairing_key(scans: DataFrame) -> DataFrame:
    """Recompute the derived column for every row."""
    return scans.withColumn("pairing_key", naming.pairing_key(F.col("original_filename")))
