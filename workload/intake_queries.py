"""Names, intake, object keys and exports."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions import keys, naming
from imprint.operators import export, intake
from imprint.operators.order import with_previous
from imprint.operators.retention import audit_rows
from imprint.session import checkpoint_dir
from imprint.sources.archives import build_archive, expand_archives, read_members
from imprint.sources.files import write_files
from imprint.sources.images import build_png, read_upright_images, turn_back
from imprint.sources.tables import append_audit, read_table, write_table
from workload.registry import query
from workload.tables import URL_BASE, Tables

_NAMED = """
SELECT archive, ordinal, path, size, regexp_replace(path, '^.*/', '') AS name,
  lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext,
  nullif(lower(regexp_extract(regexp_replace(path, '^.*/', ''), '^(.+)-(front|back)\\.[^.]+$', 2, 'i')), '') AS side,
  CASE WHEN regexp_matches(regexp_replace(path, '^.*/', ''), '^(.+)-(front|back)\\.[^.]+$', 'i')
    THEN lower(regexp_extract(regexp_replace(path, '^.*/', ''), '^(.+)-(front|back)\\.[^.]+$', 1, 'i'))
    ELSE regexp_replace(path, '^.*/', '') END AS pairing_key
FROM entries
"""
_CLASSIFIED = f"""
SELECT *, CASE WHEN ext NOT IN ('jpg', 'jpeg', 'png') THEN 'unsupported'
  WHEN side IS NULL THEN 'unmatched_naming'
  WHEN row_number() OVER (PARTITION BY archive, lower(name), side, ext IN ('jpg', 'jpeg', 'png') ORDER BY ordinal) > 1
  THEN 'duplicate' ELSE 'supported' END AS outcome
FROM ({_NAMED})
"""
_NATURAL = """
list_transform(
  list_concat(
    CASE WHEN regexp_matches({stem}, '^[0-9]') OR {stem} = '' THEN [''] ELSE [] END,
    regexp_extract_all({stem}, '[0-9]+|[^0-9]+'),
    CASE WHEN regexp_matches({stem}, '[0-9]$') THEN [''] ELSE [] END,
    CASE WHEN {side} = 'front' THEN ['0'] ELSE ['1'] END),
  lambda x, i: CASE WHEN i % 2 = 0
    THEN lpad(length(regexp_replace(x, '^0+', ''))::VARCHAR, 10, '0') || regexp_replace(x, '^0+', '') ELSE x END)
"""


def natural_sql(stem: str, side: str) -> str:
    return _NATURAL.format(stem=stem, side=side)


@query("P1", f"SELECT ordinal, side FROM ({_NAMED})", "entries")
def parse_side(t: Tables) -> DataFrame:
    return t.entries.select("ordinal", naming.parse_side(naming.basename(F.col("path"))).alias("side"))


@query("P2", f"SELECT ordinal, pairing_key FROM ({_NAMED})", "entries")
def pairing_key(t: Tables) -> DataFrame:
    name = naming.basename(F.col("path"))
    return t.entries.select("ordinal", naming.pairing_key(name).alias("pairing_key"))


@query("P4", f"SELECT ordinal, name, ext FROM ({_NAMED})", "entries")
def basename_and_extension(t: Tables) -> DataFrame:
    return intake.name_entries(t.entries).select("ordinal", "name", "ext")


@query("P3 W1", f"SELECT ordinal, outcome FROM ({_CLASSIFIED})", "entries")
def classify_entries(t: Tables) -> DataFrame:
    return intake.classify_entries(t.entries).select("ordinal", "outcome")


@query(
    "W1",
    f"""SELECT archive, min(ordinal) AS ordinal FROM ({_NAMED})
    WHERE ext IN ('jpg', 'jpeg', 'png') AND side IS NOT NULL GROUP BY archive, lower(name), side""",
    "entries",
)
def first_entries(t: Tables) -> DataFrame:
    return intake.first_entries(intake.name_entries(t.entries))


@query(
    "A5",
    f"""SELECT archive, count_if(outcome = 'supported')::BIGINT AS supported_images,
    count_if(outcome = 'unsupported')::BIGINT AS unsupported_files,
    count_if(outcome = 'unmatched_naming')::BIGINT AS unmatched_naming,
    count_if(outcome = 'duplicate')::BIGINT AS duplicate_entries,
    sum(size)::BIGINT AS uncompressed_size, (sum(size) // 2)::BIGINT AS compressed_size
    FROM ({_CLASSIFIED}) GROUP BY archive""",
    "entries",
)
def intake_summary(t: Tables) -> DataFrame:
    classified = intake.classify_entries(t.entries)
    archives = t.entries.groupBy("archive").agg(F.expr("sum(size) div 2").alias("compressed_size"))
    return intake.intake_summary(classified, archives)


@query(
    "P3 S4",
    f"""SELECT ordinal AS id, archive AS batch_id,
    concat('raw/', archive, '/', ordinal, '-', side, '.', ext) AS r2_key_raw,
    name AS original_filename, pairing_key, side, 'pending' AS status
    FROM ({_CLASSIFIED}) WHERE outcome = 'supported'""",
    "entries",
)
def supported_scans(t: Tables) -> DataFrame:
    return intake.supported_scans(intake.classify_entries(t.entries), "ordinal")


@query(
    "P5",
    """SELECT id, trim(regexp_replace(coalesce(nullif(source_label, ''), 'batch_' || id), '[^\\p{L}\\p{N}\\-_ ]', '_', 'g'))
    AS label FROM batches""",
    "batches",
)
def safe_label(t: Tables) -> DataFrame:
    return t.batches.select("id", naming.safe_label(F.col("source_label"), F.col("id")).alias("label"))


@query(
    "O6",
    f"SELECT id, array_to_string({natural_sql('pairing_key', 'side')}, '~') AS sort_key FROM scans",
    "scans",
)
def natural_sort_key(t: Tables) -> DataFrame:
    key = naming.natural_key(F.col("original_filename"), F.col("side"))
    return t.scans.select("id", F.array_join(key, "~").alias("sort_key"))


@query(
    "O6",
    f"""SELECT *, lag(id) OVER (PARTITION BY archive ORDER BY {natural_sql('lower(pairing_key)', "coalesce(side, 'back')")}, id) AS previous
    FROM (SELECT archive, ordinal AS id, pairing_key, side FROM ({_NAMED}))""",
    "entries",
)
def natural_order(t: Tables) -> DataFrame:
    named = intake.name_entries(t.entries).withColumn("id", F.col("ordinal"))
    key = naming.natural_key(F.col("name"), F.coalesce("side", F.lit("back")))
    rows = named.select("archive", "id", "pairing_key", "side", key.alias("sort_key"))
    return with_previous(rows, "archive", ["sort_key"], "id").drop("sort_key")


@query(
    "S1",
    """SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY ordinal) - 1 AS ordinal,
    path, length(path) AS size FROM (SELECT concat('up/', ordinal // 50, '.zip') AS archive, ordinal, path FROM entries)""",
    "entries",
)
def expand_archive_entries(t: Tables) -> DataFrame:
    """ZIP files are built from fifty parts each, then expanded by the source."""

    def pack(frame):
        frame = frame.sort_values("ordinal")
        body = build_archive([(p, p.encode()) for p in frame["path"]])
        return frame.iloc[:1].assign(path=f"up/{frame['bin'].iloc[0]}.zip", content=body)[["path", "content"]]

    # A fixed number of tasks: small rows, but an archive to be made of every fifty.
    binned = t.entries.select(F.expr("ordinal div 50").alias("bin"), "ordinal", "path").repartition(8 * t.spark.sparkContext.defaultParallelism, "bin")
    archives = binned.groupBy("bin").applyInPandas(pack, "path string, content binary")
    return expand_archives(archives).select("archive", "ordinal", "path", "size")


@query(
    "S1",
    """SELECT concat('up/', ordinal // 50, '.zip') AS archive, row_number() OVER (PARTITION BY ordinal // 50 ORDER BY ordinal) - 1 AS ordinal,
    path, 20 * length(path) AS size, md5(repeat(path, 20)) AS digest FROM entries""",
    "entries",
)
def archive_members(t: Tables) -> DataFrame:
    """The same archives as files of a store, each read by several tasks."""

    def pack(frame):
        frame = frame.sort_values("ordinal")
        body = build_archive([(p, (p * 20).encode()) for p in frame["path"]])
        return frame.iloc[:1].assign(path=f"up/{frame['bin'].iloc[0]}.zip", content=body)[["path", "content"]]

    # A fixed number of tasks: small rows, but an archive to be made of every fifty.
    binned = t.entries.select(F.expr("ordinal div 50").alias("bin"), "ordinal", "path").repartition(8 * t.spark.sparkContext.defaultParallelism, "bin")
    folder = f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"
    write_files(binned.groupBy("bin").applyInPandas(pack, "path string, content binary"), folder)
    members = read_members(t.spark, folder, splitBytes=2048)
    return members.select("archive", "ordinal", "path", "size", F.md5("content").alias("digest"))


@query(
    "S2",
    """SELECT vec_id AS id, CASE WHEN vec_id % 50 = 7 THEN 'crop_failed' ELSE 'decoded' END AS status,
    CASE WHEN vec_id % 50 <> 7 THEN 8 END::BIGINT AS height, CASE WHEN vec_id % 50 <> 7 THEN 4 END::BIGINT AS width,
    CASE WHEN vec_id % 50 <> 7 THEN array_to_string(list_transform(range(96), lambda i: lower(lpad(to_hex(
      greatest(0, least(255, floor(embedding[i // 3 + 1] * 1000)))::BIGINT // (i % 3 + 1)), 2, '0'))), '') END AS pixels FROM embeddings""",
)
def upright_images(t: Tables) -> DataFrame:
    """Image files with all orientations, some broken, written to a store and read as they are meant to be seen."""
    folder = f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"
    level = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 1000))).cast("int"))
    rows = t.spread("embeddings").select(F.col("vec_id").alias("id"), level.alias("level"))
    write_files(rows.mapInPandas(_stored_images, "path string, content binary"), folder)
    images = read_upright_images(t.spark, folder)
    stem = F.regexp_extract(F.col("path"), r"(\d+)\.png", 1).cast("long")
    whole = lambda c: F.when(~F.col("failed"), c)
    return images.select(
        stem.alias("id"),
        F.when(F.col("failed"), "crop_failed").otherwise("decoded").alias("status"),
        whole(F.col("image.height").cast("long")).alias("height"),
        whole(F.col("image.width").cast("long")).alias("width"),
        whole(F.lower(F.hex("image.data"))).alias("pixels"),
    )


def _stored_images(frames):
    """Files of 8x4 images (v, v // 2, v // 3), blue first, stored as their orientation asks for."""
    for frame in frames:
        out = []
        for id_, level in zip(frame["id"], frame["level"]):
            v = np.asarray(level, np.int64)[:32].reshape(8, 4)
            upright = np.stack([v, v // 2, v // 3], axis=2).astype(np.uint8)
            orientation = int(id_) % 9
            body = build_png(turn_back(upright, orientation), orientation)
            out.append((f"{id_}.png", b"broken" if id_ % 50 == 7 else body))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(
    "S3",
    "SELECT id, batch_id, side FROM scans WHERE status = 'cropped' AND batch_id > 100",
    "scans",
)
def table_scan(t: Tables) -> DataFrame:
    """Written with the fixed schema, read back with filter and columns pushed down."""
    root = f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"
    write_table(t.scans.drop("pairing_key"), root, "raw_scans")
    scans = read_table(t.spark, root, "raw_scans")
    return scans.filter("status = 'cropped' AND batch_id > 100").select("id", "batch_id", "side")


@query(
    "S4",
    """SELECT id, concat('raw/', batch_id, '/', id, '-', side, '.jpg') AS raw_key,
    concat('cropped/', batch_id, '/', id, '-', side, '.jpg') AS cropped_key,
    concat('tmp/uploads/', batch_id, '.zip') AS upload_key FROM scans""",
    "scans",
)
def object_keys(t: Tables) -> DataFrame:
    batch, scan, side = F.col("batch_id"), F.col("id"), F.col("side")
    return t.scans.select(
        "id",
        keys.raw_key(batch, scan, side, F.lit("jpg")).alias("raw_key"),
        keys.cropped_key(batch, scan, side).alias("cropped_key"),
        keys.upload_key(batch).alias("upload_key"),
    )


@query(
    "S5",
    "SELECT id, 'https://cdn.example.com/' || r2_key_cropped AS url, coalesce('https://cdn.example.com/' || r2_key_cropped, '') AS url_or_empty FROM crops",
    "crops",
)
def public_urls(t: Tables) -> DataFrame:
    key = F.col("r2_key_cropped")
    return t.crops.select(
        "id",
        keys.public_url(key, URL_BASE).alias("url"),
        keys.public_url(key, URL_BASE, "").alias("url_or_empty"),
    )


LOSERS = """
SELECT DISTINCT s.batch_id, p.card_crop_id_b AS id FROM pairs p
JOIN crops c ON p.card_crop_id_a = c.id JOIN scans s ON c.raw_scan_id = s.id WHERE p.status = 'confirmed_duplicate'
"""
MANIFEST = f"""
SELECT s.batch_id, c.id, c.r2_key_cropped,
  concat(regexp_replace(s.original_filename, '\\.[^.]*$', ''), '_', s.side, '.jpg') AS output_name,
  (coalesce(c.rotation_degrees, 0) % 360)::BIGINT AS rotation_degrees, s.pairing_key, s.side
FROM crops c JOIN scans s ON c.raw_scan_id = s.id
WHERE c.r2_key_cropped IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM ({LOSERS}) l WHERE l.batch_id = s.batch_id AND l.id = c.id)
"""


@query(
    "S6 J7",
    f"""SELECT batch_id, id, r2_key_cropped, output_name, rotation_degrees,
    array_to_string({natural_sql('pairing_key', 'side')}, '~') AS sort_key FROM ({MANIFEST})""",
    "scans crops pairs",
)
def export_manifest(t: Tables) -> DataFrame:
    manifest = export.in_export_order(export.export_manifest(t.crops, t.scans, t.candidates))
    return manifest.withColumns(
        {
            "sort_key": F.array_join("sort_key", "~"),
            "rotation_degrees": F.col("rotation_degrees").cast("long"),
        }
    )


@query(
    "S7",
    f"""SELECT batch_id, n AS image_count, total_size,
    substr(sha256(concat_ws('|', n, high, low)), 1, 16) AS checksum FROM (
      SELECT batch_id, count(*) AS n, sum(1000 + id % 77)::BIGINT AS total_size,
        sum(('0x' || substr(digest, 1, 15))::BIGINT) AS high, sum(('0x' || substr(digest, 16, 15))::BIGINT) AS low
      FROM (SELECT *, sha256(concat_ws('|', id, r2_key_cropped, output_name, rotation_degrees)) AS digest FROM ({MANIFEST}))
      GROUP BY batch_id)""",
    "scans crops pairs",
)
def manifest_summary(t: Tables) -> DataFrame:
    manifest = export.export_manifest(t.crops, t.scans, t.candidates)
    sizes = t.crops.select("id", (1000 + F.col("id") % 77).alias("size"))
    return export.manifest_summary(manifest, sizes)


@query("S9", "SELECT id, pairing_key FROM scans", "scans")
def backfill_pairing_key(t: Tables) -> DataFrame:
    return intake.backfill_pairing_key(t.scans.drop("pairing_key")).select("id", "pairing_key")


@query(
    "S10",
    """SELECT b.id AS batch_id, 'hard_delete' AS action, b.status AS batch_status, count(s.id)::BIGINT AS scan_count
    FROM batches b LEFT JOIN scans s ON s.batch_id = b.id GROUP BY ALL""",
    "batches scans",
)
def append_audit_log(t: Tables) -> DataFrame:
    """Audit rows of all batches, appended to a fresh log in two writes."""
    root = f"{checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"
    removals = t.scans.selectExpr("batch_id", "r2_key_raw AS key", "CAST(NULL AS STRING) AS error")
    append_audit(audit_rows(t.batches.filter("status <> 'extracting'"), t.scans, removals), root)
    append_audit(audit_rows(t.batches.filter("status = 'extracting'"), t.scans, removals), root)
    return read_table(t.spark, root, "audit_log").select("batch_id", "action", "batch_status", "scan_count")
