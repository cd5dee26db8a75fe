"""Scan intake, fingerprint matching and review bookkeeping as Spark DataFrame operators."""

from imprint.config import AdmissionConfig, AlertConfig, CropConfig, MatchConfig

__all__ = ["AdmissionConfig", "AlertConfig", "CropConfig", "MatchConfig"]
