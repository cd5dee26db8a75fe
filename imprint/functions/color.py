"""Distances between colour histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imprint.functions.bits import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def bhattacharyya(left: Column, right: Column) -> Column:
    """0 for equal histograms, 1 for disjoint ones.

    NULL when either histogram is empty or missing: such a pair never matches.
    """
    overlap = F.aggregate(
        F.zip_with(left, right, lambda a, b: F.sqrt(a.cast("double") * b.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    scale = _total(left) * _total(right)
    return F.when(scale > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - overlap / F.sqrt(scale))))


def root_shares(values: Column) -> Column:
    """Square roots of a histogram's shares; NULL for an empty one.

    Taken once per histogram, they leave a single product sum per pair.
    """
    total = _total(values)
    return F.when(
        total > 0,
        let(total, lambda t: F.transform(values, lambda x: F.sqrt(x.cast("double") / t))),
    )


def distance_of_roots(left: Column, right: Column) -> Column:
    """``bhattacharyya`` of two histograms given as root shares."""
    overlap = F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
    # NULL stays NULL here, where greatest(0, NULL) would make it a perfect match.
    return let(overlap, lambda o: F.when(o.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - o))))
