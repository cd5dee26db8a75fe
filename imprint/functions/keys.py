"""Object store keys and public addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_key(batch_id: Column, scan_id: Column, side: Column, ext: Column) -> Column:
    return F.concat(
        F.lit("raw/"), batch_id.cast("string"), F.lit("/"), scan_id.cast("string"),
        F.lit("-"), side, F.lit("."), ext,
    )


def cropped_key(batch_id: Column, crop_id: Column, side: Column) -> Column:
    return F.concat(
        F.lit("cropped/"), batch_id.cast("string"), F.lit("/"), crop_id.cast("string"),
        F.lit("-"), side, F.lit(".jpg"),
    )


def upload_key(batch_id: Column) -> Column:
    return F.concat(F.lit("tmp/uploads/"), batch_id.cast("string"), F.lit(".zip"))


def public_url(key: Column, base: str, missing: str | None = None) -> Column:
    """Address of a stored object; ``missing`` where there is no key."""
    address = F.concat(F.lit(base.rstrip("/") + "/"), key)
    return F.when(F.coalesce(key, F.lit("")) != "", address).otherwise(F.lit(missing))
