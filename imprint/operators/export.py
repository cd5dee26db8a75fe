"""Export manifests: which images leave, under which name, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions import naming
from imprint.functions.numeric import turn
from imprint.operators.catalog import without_losers
from imprint.operators.status import crops_with_scans


def export_manifest(
    crops: DataFrame, scans: DataFrame, candidates: DataFrame, scope: str = "owner"
) -> DataFrame:
    """Non-duplicate stored images with output name, rotation and sort key."""
    stored = crops.filter(F.col("r2_key_cropped").isNotNull())
    listed = crops_with_scans(
        stored.select("id", "raw_scan_id", "r2_key_cropped", "rotation_degrees"),
        scans.select("id", "batch_id", "original_filename", "side"),
    )
    kept = without_losers(listed, candidates, crops, scans, scope)
    name, side = F.col("original_filename"), F.col("side")
    return kept.select(
        "batch_id",
        "id",
        "r2_key_cropped",
        F.concat(naming.stem(name), F.lit("_"), side, F.lit(".jpg")).alias("output_name"),
        turn(F.col("rotation_degrees"), F.lit(0)).alias("rotation_degrees"),
        naming.natural_key(name, side).alias("sort_key"),
    )


def in_export_order(manifest: DataFrame) -> DataFrame:
    """Manifest sorted by batch and natural name order.

    A range sort on the full key: a batch of any size is cut between tasks.
    """
    return manifest.orderBy("batch_id", "sort_key", "id")


def write_manifest(manifest: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write the ordered manifest, one folder per batch."""
    rows = in_export_order(manifest).drop("sort_key")
    rows.write.partitionBy("batch_id").format(file_format).mode("overwrite").save(path)


def manifest_summary(manifest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Image count, bytes and a 16-digit SHA-256 checksum per batch.

    ``sizes`` has ``id`` and ``size``. The checksum covers the set of manifest
    lines, whose natural order follows from the names in them: lines are hashed
    one by one and the hashes are added up, so a batch is never gathered in one
    place.
    """
    line = F.concat_ws(
        "|", F.col("id"), "r2_key_cropped", "output_name", F.col("rotation_degrees").cast("string")
    )
    digest = F.sha2(line, 256)

    def part(start: int):
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)"))

    return (
        manifest.join(sizes.select("id", "size"), "id", "left")
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("image_count"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
            part(1).alias("_high"),
            part(16).alias("_low"),
        )
        .select(
            "batch_id",
            "image_count",
            "total_size",
            F.substring(
                F.sha2(F.concat_ws("|", "image_count", F.col("_high").cast("string"), F.col("_low").cast("string")), 256),
                1,
                16,
            ).alias("checksum"),
        )
    )
