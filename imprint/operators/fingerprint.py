"""Fingerprints of decoded images.

Works on the struct of Spark's ``image`` source: rows of blue, green, red bytes.
The pixel arithmetic is numpy over Arrow batches; Spark places the images.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.config import CropConfig
from imprint.schemas import PRINT, ROTATIONS

HASH_INPUT = 32
HASH_SIDE = 8
BORDER_FRACTION = 0.12
HUE_BINS, SATURATION_BINS = 16, 8
_STACK_BYTES = 8 << 20


def pixels(image) -> np.ndarray:
    """Height x width x 3 array, blue first, of an image struct."""
    height, width, channels = image["height"], image["width"], image["nChannels"]
    flat = np.frombuffer(image["data"], dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(flat, 3, axis=2) if channels == 1 else flat[:, :, :3]


def _gray(bgr: np.ndarray, weights: tuple[int, int, int], shift: int) -> np.ndarray:
    total = bgr.astype(np.int64) @ np.array(weights)
    return (total + (1 << (shift - 1))) >> shift


# Integer luma weights for blue, green, red, with their scale.
_LUMA = ((7471, 38470, 19595), 16)
_LUMA_BACKGROUND = ((1868, 9617, 4899), 14)


#: Weights are whole multiples of two to the minus these powers. All sums then stay
#: whole numbers below 2 to the 53rd, so they are exact in any order and on any engine.
WEIGHT_BITS, COSINE_BITS = 22, 16


@lru_cache(maxsize=256)
def resampling_weights(size: int, out: int) -> np.ndarray:
    """Weights that resample ``size`` samples to ``out`` with a 3-lobed window."""
    stretch = max(1.0, size / out)
    centers = (np.arange(out) + 0.5) * size / out
    offsets = (np.arange(size)[None, :] + 0.5 - centers[:, None]) / stretch
    weights = np.where(np.abs(offsets) < 3, np.sinc(offsets) * np.sinc(offsets / 3), 0.0)
    return np.rint(weights / weights.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS))


@lru_cache(maxsize=1)
def cosine_weights() -> np.ndarray:
    """Lowest rows of the type-II cosine transform."""
    k, n = np.arange(HASH_SIDE)[:, None], np.arange(HASH_INPUT)[None, :]
    return np.rint(2 * np.cos(np.pi * k * (2 * n + 1) / (2 * HASH_INPUT)) * (1 << COSINE_BITS))


def _level(sums: np.ndarray) -> np.ndarray:
    """Weighted sums as levels from 0 to 255, halves upwards."""
    return np.clip(np.floor((sums + (1 << (WEIGHT_BITS - 1))) / (1 << WEIGHT_BITS)), 0, 255)


def structural_hashes(bgr: np.ndarray) -> np.ndarray:
    """64-bit perceptual hashes, as signed integers, of a stack of images."""
    gray = _gray(bgr, *_LUMA).astype(np.float64)
    _, height, width = gray.shape
    across = _level(gray @ resampling_weights(width, HASH_INPUT).T)
    small = _level(resampling_weights(height, HASH_INPUT) @ across)
    low = (cosine_weights() @ small @ cosine_weights().T).reshape(len(bgr), -1)
    ranked = np.sort(low, axis=1)
    bits = 2 * low > (ranked[:, 31] + ranked[:, 32])[:, None]
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def _hue_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue in [0, 180) and saturation in [0, 256) of pixels."""
    blue, green, red = np.moveaxis(bgr.astype(np.float64), -1, 0)
    high = np.maximum(np.maximum(blue, green), red)
    spread = high - np.minimum(np.minimum(blue, green), red)
    safe = np.where(spread == 0, 1, spread)
    sector = np.select(
        [high == red, high == green],
        [(green - blue) / safe, 2 + (blue - red) / safe],
        4 + (red - green) / safe,
    )
    hue = np.where(spread == 0, 0, np.rint(sector * 30)) % 180
    saturation = np.rint(255 * spread / np.where(high == 0, 1, high))
    return hue, saturation


def color_signatures(bgr: np.ndarray) -> np.ndarray:
    """128-bin hue and saturation histograms of the border rings, scaled to [0, 1]."""
    count, height, width = bgr.shape[:3]
    rows, cols = max(1, int(height * BORDER_FRACTION)), max(1, int(width * BORDER_FRACTION))
    ring = np.zeros((height, width), dtype=bool)
    ring[:rows] = ring[-rows:] = True
    ring[:, :cols] = ring[:, -cols:] = True
    hue, saturation = _hue_saturation(bgr[:, ring])
    bins = HUE_BINS * SATURATION_BINS
    cell = (hue * HUE_BINS // 180) * SATURATION_BINS + saturation * SATURATION_BINS // 256
    cell = cell.astype(np.int64) + bins * np.arange(count)[:, None]
    counts = np.bincount(cell.ravel(), minlength=bins * count).reshape(count, bins).astype(np.float64)
    low, high = counts.min(axis=1, keepdims=True), counts.max(axis=1, keepdims=True)
    return ((counts - low) / np.where(high > low, high - low, 1)).astype(np.float32)


def rotate(bgr: np.ndarray, degrees: int) -> np.ndarray:
    """Stack of images after clockwise quarter turns."""
    return np.rot90(bgr, -(degrees // 90), axes=(1, 2))


def background_fractions(bgr: np.ndarray, threshold: int) -> np.ndarray:
    """Share of dark pixels along each frame; a corner lies on two edges."""
    edge = np.concatenate([bgr[:, 0], bgr[:, -1], bgr[:, :, 0], bgr[:, :, -1]], axis=1)
    return (_gray(edge, *_LUMA_BACKGROUND) <= threshold).mean(axis=1)


def print_stack(bgr: np.ndarray) -> list[list[dict]]:
    """Fingerprints at four rotations of each image of a stack."""
    prints: list[list[dict]] = [[] for _ in bgr]
    for degrees in ROTATIONS:
        turned = rotate(bgr, degrees)
        for i, (code, color) in enumerate(zip(structural_hashes(turned), color_signatures(turned))):
            prints[i].append({"rotation": degrees, "hash": int(code), "color": color.tolist()})
    return prints


def _map_images(
    images: DataFrame, column: str, kind: T.DataType, compute, rotation: str | None = None
) -> DataFrame:
    """Replace ``image`` by a value computed from its pixels; other columns pass.

    Images of one size and rotation are computed as a stack of some 8 MB. An
    image that could not be decoded, or is NULL, gets a NULL value.
    """
    kept = [f for f in images.schema.fields if f.name != "image"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stacks: dict[tuple, list[int]] = {}
            turns = frame[rotation].fillna(0).astype(int) % 360 if rotation else None
            for i, image in enumerate(frame["image"]):
                if image is None or image["height"] is None or image["height"] <= 0:
                    continue  # not decoded: the value stays NULL
                degrees = 0 if turns is None else int(turns[i])
                stacks.setdefault((image["height"], image["width"], degrees), []).append(i)
            values = pd.Series([None] * len(frame), dtype=object)
            for (height, width, degrees), members in stacks.items():
                step = max(1, _STACK_BYTES // (height * width * 3))
                for start in range(0, len(members), step):
                    part = members[start : start + step]
                    stack = np.stack([pixels(frame["image"][i]) for i in part])
                    for i, value in zip(part, compute(rotate(stack, degrees))):
                        values[i] = value
            yield frame.drop(columns="image").assign(**{column: values})

    return images.mapInPandas(run, T.StructType([*kept, T.StructField(column, kind)]))


def eligible_crops(crops: DataFrame, scans: DataFrame) -> DataFrame:
    """Crops to be hashed: fronts with a stored image."""
    fronts = scans.filter(F.col("side") == "front").select(F.col("id").alias("raw_scan_id"), "batch_id")
    return crops.filter(F.col("r2_key_cropped").isNotNull()).join(fronts, "raw_scan_id")


def fingerprint_images(images: DataFrame, rotation: str | None = None) -> DataFrame:
    """Replace ``image`` by ``prints``: hash and colours at four rotations.

    ``rotation`` names a column of degrees that is applied first.
    """

    return _map_images(images, "prints", T.ArrayType(PRINT), print_stack, rotation)


def border_background(images: DataFrame, config: CropConfig = CropConfig()) -> DataFrame:
    """Replace ``image`` by ``background_fraction``."""
    threshold = config.background_threshold
    return _map_images(
        images, "background_fraction", T.DoubleType(), lambda stack: background_fractions(stack, threshold)
    )
