"""Decoded images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORIENTATION_TAG = 0x0112


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images decoded on the JVM: ``path``, ``image`` and ``failed``.

    A file that cannot be decoded stays as a row with ``failed`` set.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    return images.select(
        F.col("image.origin").alias("path"), "image", (F.col("image.height") <= 0).alias("failed")
    )


def _exif_orientation(block: bytes) -> int:
    """Display orientation (1 to 8) in an EXIF block; 1 without one."""
    order = "<" if block[:2] == b"II" else ">"
    try:
        (start,) = struct.unpack_from(order + "I", block, 4)
        (count,) = struct.unpack_from(order + "H", block, start)
        for i in range(count):
            tag, _, _, value = struct.unpack_from(order + "HHIH", block, start + 2 + 12 * i)
            if tag == ORIENTATION_TAG:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def _orientation(data: bytes) -> int:
    """Display orientation (1 to 8) noted in a JPEG or PNG file; 1 without one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if kind == b"eXIf":
                return _exif_orientation(data[at + 8 : at + 8 + size])
            at += 12 + size
        return 1
    at = 2
    while data[:2] == b"\xff\xd8" and at + 10 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _exif_orientation(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def display_orientation(files: DataFrame) -> DataFrame:
    """Replace ``content`` by the display orientation noted in the file."""
    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_orientation(bytes(body)) for body in frame["content"]]
            yield frame.drop(columns="content").assign(orientation=found)

    return files.mapInPandas(run, f"{schema}, orientation int")


def turn_upright(bgr: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (height x width x channels) as they are meant to be seen.

    Values 2, 4, 5 and 7 mirror, 5 to 8 also swap rows and columns; others than 1 to
    8 leave the pixels as they are.
    """
    if orientation in (5, 6, 7, 8):
        bgr = bgr.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        bgr = bgr[:, ::-1]
    if orientation in (3, 4, 7, 8):
        bgr = bgr[::-1]
    return bgr


def turn_back(bgr: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are stored with an orientation; undone by ``turn_upright``."""
    if orientation in (3, 4, 7, 8):
        bgr = bgr[::-1]
    if orientation in (2, 3, 6, 7):
        bgr = bgr[:, ::-1]
    return bgr.transpose(1, 0, 2) if orientation in (5, 6, 7, 8) else bgr


def build_png(bgr: np.ndarray, orientation: int = 0) -> bytes:
    """A PNG file of blue-first pixels, with a note of the orientation (1 to 8) if given."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = bgr.shape[:2]
    lines = b"".join(b"\0" + row[:, ::-1].astype(np.uint8).tobytes() for row in bgr)
    note = b""
    if 1 <= orientation <= 8:
        note = chunk(b"eXIf", b"MM" + struct.pack(">HIHHHIHHI", 42, 8, 1, ORIENTATION_TAG, 3, 1, orientation, 0, 0))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + note + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def apply_orientation(images: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Turn ``image`` upright by a column of orientations, which is dropped; other columns pass.

    A NULL orientation, or 1, changes nothing, and neither does an image that was not
    decoded.
    """
    kept = [f for f in images.schema.fields if f.name != orientation]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            turned = []
            for image, value in zip(frame["image"], frame[orientation]):
                if image is not None and image["height"] and image["height"] > 0 and not pd.isna(value) and 2 <= value <= 8:
                    shape = (image["height"], image["width"], image["nChannels"])
                    pixels = turn_upright(np.frombuffer(image["data"], np.uint8).reshape(shape), int(value))
                    image = {**image, "height": pixels.shape[0], "width": pixels.shape[1], "data": pixels.tobytes()}
                turned.append(image)
            yield frame.drop(columns=orientation).assign(image=turned)[[f.name for f in kept]]

    return images.mapInPandas(run, StructType(kept))


def read_upright_images(spark: SparkSession, path: str) -> DataFrame:
    """``read_images`` with the orientation noted in each file applied to its pixels."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    noted = display_orientation(files).filter("orientation <> 1")
    key = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    images = read_images(spark, path).withColumn("_key", key("path"))
    return apply_orientation(
        images.join(noted.select(key("path").alias("_key"), "orientation"), "_key", "left").drop("_key")
    )
