"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.session import materialize


def hot_keys(rows: DataFrame, keys: list[str], split_rows: int, total: int) -> DataFrame | None:
    """Keys holding more than ``split_rows`` rows, with a number of chunks each.

    The threshold rises with ``total`` so that the result never has more than
    100 000 rows and is always small enough to broadcast. None when ``total`` is
    too small for any key to be hot, or when none is.
    """
    threshold = max(split_rows, total // 100_000)
    if total <= threshold:
        return None
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(
        counted.filter(F.col("_rows") > threshold).select(
            *keys, F.ceil(F.col("_rows") / threshold).cast("int").alias("_chunks")
        )
    )
    return None if hot.isEmpty() else hot


def _chunks_of(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    if hot is None:
        return df.withColumn("_chunks", F.lit(1))
    return df.join(F.broadcast(hot), keys, "left").withColumn(
        "_chunks", F.coalesce("_chunks", F.lit(1))
    )


def assign_chunk(
    df: DataFrame, hot: DataFrame | None, keys: list[str], spread_by: str, chunk: str
) -> DataFrame:
    """Put each row into one chunk of its key."""
    return (
        _chunks_of(df, hot, keys)
        .withColumn(chunk, F.pmod(F.xxhash64(spread_by), F.col("_chunks")).cast("int"))
        .drop("_chunks")
    )


def visit_chunks(df: DataFrame, hot: DataFrame | None, keys: list[str], chunk: str) -> DataFrame:
    """Repeat each row once for every chunk of its key."""
    return (
        _chunks_of(df, hot, keys)
        .withColumn(chunk, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .drop("_chunks")
    )


def chunked_join(
    pairs: DataFrame,
    members: DataFrame,
    keys: list[str],
    spread_by: str,
    split_rows: int,
    total: int,
) -> DataFrame:
    """``pairs`` joined to all ``members`` of their key.

    The members of a hot key lie in several chunks under separate join keys, so
    that no single task receives them all.
    """
    hot = hot_keys(members, keys, split_rows, total)
    if hot is None:
        return pairs.join(members, keys)
    left = visit_chunks(pairs, hot, keys, "_chunk")
    right = assign_chunk(members, hot, keys, spread_by, "_chunk")
    return left.join(right, [*keys, "_chunk"]).drop("_chunk")
