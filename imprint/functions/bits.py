"""64-bit hashes held in a LONG."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 8


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A one-element transform binds it, so a lambda inside ``body`` does not
    evaluate it again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_from_hex(text: Column) -> Column:
    """16 hex digits as a signed LONG with the same bits."""
    return F.conv(text, 16, -10).cast("long")


def hash_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def median_bits(values: Column) -> Column:
    """Hash of 64 numbers: one bit each, set when above their median."""
    numbers = F.transform(values, lambda x: x.cast("double"))
    ranked = F.sort_array(numbers)
    middle = let(ranked, lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2)
    return let(
        middle,
        lambda median: F.aggregate(
            values,
            F.lit(0).cast("long"),
            lambda bits, x: F.shiftleft(bits, 1).bitwiseOR(
                F.when(x.cast("double") > median, 1).otherwise(0).cast("long")
            ),
        ),
    )


def turn_grid(values: Column, quarter_turns: int) -> Column:
    """Row-major 8x8 grid after clockwise quarter turns."""
    order = list(range(GRID * GRID))
    for _ in range(quarter_turns % 4):
        order = [order[(GRID - 1 - col) * GRID + row] for row in range(GRID) for col in range(GRID)]
    if quarter_turns % 4 == 0:
        return values
    picks = F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>")
    return F.transform(picks, lambda i: F.get(values, i))


def grid_prints(values: Column, color: Column) -> Column:
    """Fingerprints of an 8x8 grid at 0, 90, 180 and 270 degrees clockwise."""
    return F.array(
        *[
            F.struct(
                F.lit(90 * turns).cast("int").alias("rotation"),
                median_bits(turn_grid(values, turns)).alias("hash"),
                color.cast("array<float>").alias("color"),
            )
            for turns in range(4)
        ]
    )
