"""Scan geometry over a table of detected rectangles.

A *detection row* has ``image``, ``ordinal``, ``width``, ``height`` (sides of the
rectangle), ``area`` (of the contour), ``image_width`` and ``image_height``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.config import CropConfig
from imprint.functions.bits import let


def is_precropped(background_fraction: Column, config: CropConfig = CropConfig()) -> Column:
    """Few background pixels around the border: already cut to the card."""
    return background_fraction <= config.precropped_background_max


def tolerance(precropped: Column, config: CropConfig = CropConfig()) -> Column:
    return F.when(precropped, config.precropped_ratio_tolerance).otherwise(config.ratio_tolerance)


def aspect_ratio(width: Column, height: Column) -> Column:
    """Long side over short side; 0 without a short side."""
    short = F.least(width, height)
    return F.when(short > 0, F.greatest(width, height) / F.nullif(short, F.lit(0.0))).otherwise(0.0)


def aspect_ok(ratio: Column, allowed: Column | float, config: CropConfig = CropConfig()) -> Column:
    return F.abs(ratio - config.expected_ratio) <= allowed


def orientation(width: Column, height: Column) -> Column:
    return F.when(width >= height, "landscape").otherwise("portrait")


def output_canvas(oriented: Column, config: CropConfig = CropConfig()) -> Column:
    """Struct (width, height) of the straightened image."""
    short = min(config.output_width, config.output_height)
    long = max(config.output_width, config.output_height)
    flat = oriented == "landscape"
    return F.struct(
        F.when(flat, long).otherwise(short).alias("width"),
        F.when(flat, short).otherwise(long).alias("height"),
    )


def best_detection(detections: DataFrame, config: CropConfig = CropConfig()) -> DataFrame:
    """The most card-like detection of each image.

    Rectangles under the least area are dropped. The score adds the aspect error
    to a penalty for being smaller than the largest one of the image; the least
    score wins, then the smaller share of the frame, then the earlier ordinal.
    Images without a candidate have no row.
    """
    frame = F.col("image_width") * F.col("image_height")
    candidates = detections.filter(F.col("area") >= frame * config.min_area_fraction)
    # Two partial aggregates and a lookup of one row per image: an image with a
    # huge number of detections never has to be sorted in one task.
    largest = candidates.groupBy("image").agg(F.max("area").alias("_largest"))
    relative = F.col("area") / F.greatest(F.lit(1), F.floor("_largest"))
    error = F.abs(aspect_ratio(F.col("width"), F.col("height")) - config.expected_ratio)
    valid = (F.col("width") > 0) & (F.col("height") > 0)
    scored = candidates.join(largest, "image").withColumns(
        {
            "score": F.when(valid, error + (1 - relative) * config.size_weight).otherwise(
                F.lit(float("inf"))
            ),
            "area_ratio": F.when(valid, F.col("area") / F.greatest(F.lit(1), frame)).otherwise(0.0),
        }
    )
    best = F.min(
        F.struct("score", "area_ratio", "ordinal", "width", "height", "area", "image_width", "image_height")
    )
    return scored.groupBy("image").agg(best.alias("best")).select("image", "best.*")


def all_detections(first: DataFrame, second: DataFrame) -> DataFrame:
    """Detections of two detectors; the second one's ordinals follow the first's."""
    return first.withColumn("detector", F.lit(0)).unionByName(second.withColumn("detector", F.lit(1)))


def padded_sides(width: Column, height: Column, config: CropConfig = CropConfig()) -> Column:
    """Struct (padding, width, height) of the rectangle grown on every side."""
    padding = F.greatest(
        F.lit(float(config.padding_min)), F.greatest(width, height) * config.padding_fraction
    )
    return F.struct(
        padding.alias("padding"),
        (width + padding * 2).alias("width"),
        (height + padding * 2).alias("height"),
    )


def clip_points(points: Column, image_width: Column, image_height: Column) -> Column:
    """Corner points moved inside the frame."""

    def inside(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(value, (size - 1).cast("double")))

    return F.transform(
        points,
        lambda p: F.array(
            inside(F.get(p, F.lit(0)), image_width), inside(F.get(p, F.lit(1)), image_height)
        ),
    )


def order_corners(points: Column) -> Column:
    """Four points as top-left, top-right, bottom-right, bottom-left.

    The first point wins a tie.
    """

    def first_least(key) -> Column:
        ranked = F.transform(
            points,
            lambda p, i: F.struct(
                key(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("key"), i.alias("i"), p.alias("p")
            ),
        )
        return F.array_min(ranked)["p"]

    return F.array(
        first_least(lambda x, y: x + y),
        first_least(lambda x, y: y - x),
        first_least(lambda x, y: -(x + y)),
        first_least(lambda x, y: x - y),
    )


def _distance(corners: Column, i: int, j: int) -> Column:
    def part(k: int) -> Column:
        a = F.get(F.get(corners, F.lit(i)), F.lit(k))
        return a - F.get(F.get(corners, F.lit(j)), F.lit(k))

    return F.sqrt(part(0) * part(0) + part(1) * part(1))


def side_lengths(corners: Column) -> Column:
    """Struct (width, height): the longer of each pair of opposite edges."""
    return let(
        corners,
        lambda c: F.struct(
            F.greatest(_distance(c, 2, 3), _distance(c, 1, 0)).alias("width"),
            F.greatest(_distance(c, 1, 2), _distance(c, 0, 3)).alias("height"),
        ),
    )


def polygon_area(points: Column) -> Column:
    """Area enclosed by corner points in order (shoelace formula)."""
    following = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(
        points,
        following,
        lambda p, q: F.get(p, F.lit(0)) * F.get(q, F.lit(1)) - F.get(q, F.lit(0)) * F.get(p, F.lit(1)),
    )
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)) / 2


def area_fraction(points: Column, image_width: Column, image_height: Column) -> Column:
    return polygon_area(points) / (image_width * image_height)


def crop_box(points: Column) -> Column:
    """Stored box of a crop: ordered corners, aspect ratio, orientation."""
    return let(
        order_corners(points),
        lambda corners: let(
            F.struct(corners.alias("points"), side_lengths(corners).alias("sides")),
            lambda c: F.struct(
                c["points"].alias("points"),
                aspect_ratio(c["sides"]["width"], c["sides"]["height"]).alias("aspect_ratio"),
                orientation(c["sides"]["width"], c["sides"]["height"]).alias("orientation"),
            ),
        ),
    )


def frame_box(image_width: Column, image_height: Column) -> Column:
    """Box of an image that was already cropped: the whole frame."""
    right = (image_width - 1).cast("double")
    bottom = (image_height - 1).cast("double")
    zero = F.lit(0.0)
    points = [(zero, zero), (right, zero), (right, bottom), (zero, bottom)]
    return F.struct(
        F.array(*[F.array(x, y) for x, y in points]).alias("points"),
        aspect_ratio(image_width.cast("double"), image_height.cast("double")).alias("aspect_ratio"),
        orientation(image_width, image_height).alias("orientation"),
    )


def crop_outcome(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """Scan status after the geometry check.

    ``checks`` has one row per image with a usable rectangle: (scan_id,
    aspect_ratio_ok). A failed gate and a missing row both mean crop_failed, but
    only the former has a crop (``has_crop``).
    """
    checked = checks.select(
        F.col("scan_id").alias("id"), "aspect_ratio_ok", F.lit(True).alias("has_crop")
    )
    return (
        scans.drop("status")
        .join(checked, "id", "left")
        .withColumns(
            {
                "status": F.when(F.col("aspect_ratio_ok"), "cropped").otherwise("crop_failed"),
                "has_crop": F.coalesce("has_crop", F.lit(False)),
            }
        )
    )
