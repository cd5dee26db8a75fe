"""Tunable thresholds, handed to operators as frozen values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    """Bounds of the duplicate search.

    ``split_rows`` is a cluster setting, not a limit on results: a hash, band
    value or group of copies holding more rows than this is divided over
    several tasks.
    """

    structural_max: int = 10
    color_max: float = 0.2
    split_rows: int = 200_000


@dataclass(frozen=True)
class CropConfig:
    """Card geometry, in pixels unless named a fraction or ratio."""

    expected_ratio: float = 3.5 / 2.5
    ratio_tolerance: float = 0.15
    precropped_ratio_tolerance: float = 0.35
    background_threshold: int = 8
    precropped_background_max: float = 0.8
    padding_fraction: float = 0.07
    padding_min: int = 10
    min_area_fraction: float = 0.005
    size_weight: float = 0.5
    output_width: int = 750
    output_height: int = 1050


@dataclass(frozen=True)
class AdmissionConfig:
    """At most ``max_attempts`` admitted events per key in ``window_seconds``."""

    max_attempts: int = 10
    window_seconds: float = 60.0


@dataclass(frozen=True)
class AlertConfig:
    """When a batch counts as stuck and a failure rate as high."""

    stuck_seconds: int = 600
    failure_rate: float = 0.2
    warning_rate: float = 0.05
    min_tasks: int = 10
