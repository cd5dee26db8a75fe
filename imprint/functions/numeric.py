"""Scalar rules over numbers: sanitising, rotation, progress, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imprint.schemas import ROTATIONS


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(value + F.lit(0.5))


def quarter_turn(degrees: Column) -> Column:
    """Degrees normalised to 90, 180 or 270; NULL when not a quarter turn."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when(turned.isin(ROTATIONS[1:]), turned)


def turn(current: Column, degrees: Column) -> Column:
    return F.pmod(F.coalesce(current, F.lit(0)) + degrees, F.lit(360))


def percent(value: Column, total: Column) -> Column:
    share = round_half_up(value / F.nullif(total, F.lit(0)) * 100)
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(F.lit(100), share)).cast("long")


def batch_progress(
    status: Column,
    scans: Column,
    cropped: Column,
    crop_failed: Column,
    pending_rotation: Column,
    pending_duplicates: Column,
) -> Column:
    """Progress from 0 to 100 of a batch in a given status."""
    rotation = round_half_up(
        60 + (cropped - pending_rotation) / F.nullif(cropped, F.lit(0)) * 20
    )
    cropping = round_half_up(20 + (cropped + crop_failed) / F.nullif(scans, F.lit(0)) * 40)
    return (
        F.when(status == "complete", 100)
        .when((status == "duplicate_review") & (pending_duplicates == 0), 98)
        .when(status == "duplicate_review", 80)
        .when((status == "rotation_review") & (cropped <= 0), 60)
        .when(status == "rotation_review", rotation)
        .when((status == "cropping") & (scans > 0), cropping)
        .otherwise(20)
        .cast("long")
    )


def structural_similarity(distance: Column) -> Column:
    """Share of equal hash bits."""
    return 1 - distance / 64


def color_similarity(distance: Column) -> Column:
    return 1 - distance


def confidence(structural: Column, color: Column) -> Column:
    """Band of the mean of two similarities, or of the one that is known."""
    score = F.coalesce((structural + color) / 2, structural, color)
    return (
        F.when(score.isNull(), "unknown")
        .when(score >= 0.9, "high")
        .when(score >= 0.7, "medium")
        .otherwise("low")
    )
