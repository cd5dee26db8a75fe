"""The duplicate search from fingerprints to new candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from imprint.config import MatchConfig
from imprint.operators.duplicates import (
    all_hits,
    canonical_pairs,
    emit_candidates,
    ids_once,
    insert_if_absent,
)


def find_duplicates(
    new: DataFrame,
    history: DataFrame | None = None,
    existing: DataFrame | None = None,
    config: MatchConfig = MatchConfig(),
    direction: str = "later",
) -> DataFrame:
    """Candidate pairs that new print rows add.

    Without ``history`` the new rows are matched among themselves, the larger id
    being the query, or either id under ``direction='either'``.
    """
    hits = all_hits(new, history, config, direction)
    return new_candidates(hits, existing, direction == "later" and ids_once(new, history))


def new_candidates(hits: DataFrame, existing: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Candidate rows of the hits that are not yet recorded; ``once`` as for ``canonical_pairs``."""
    return emit_candidates(insert_if_absent(canonical_pairs(hits, once), existing))
