"""File name conventions: ``{card}-front.jpg`` and ``{card}-back.jpg``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?d): only \n ends a line, so that "." covers every other character.
_SIDED_NAME = r"(?id)^(.+)-(front|back)\.[^.]+$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text after the last dot, lower-cased; NULL for a name without a dot."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1)))


def stem(name: Column) -> Column:
    """Name without its last extension; a name without a dot is its own stem."""
    return F.regexp_replace(name, r"(?s)\.[^.]*\z", "")


def parse_side(name: Column) -> Column:
    """'front', 'back', or NULL for a name outside the convention."""
    return F.nullif(F.lower(F.regexp_extract(name, _SIDED_NAME, 2)), F.lit(""))


def pairing_key(name: Column) -> Column:
    """Key shared by the two sides of a card.

    A name outside the convention is its own key and keeps its case.
    """
    card = F.regexp_extract(name, _SIDED_NAME, 1)
    return F.when(card == "", name).otherwise(F.lower(card))


def safe_label(label: Column, batch_id: Column) -> Column:
    """Batch label usable as a file name."""
    named = F.coalesce(
        F.nullif(label, F.lit("")), F.concat(F.lit("batch_"), batch_id.cast("string"))
    )
    return F.trim(F.regexp_replace(named, r"[^\p{L}\p{N}\-_ ]", "_"))


def _number_key(digits: Column) -> Column:
    """Text that sorts as the number does, at any length."""
    significant = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(significant).cast("string"), 10, "0"), significant)


def natural_key(name: Column, side: Column) -> Column:
    """Array sorting card-2 before card-10, and a front before its back.

    Even positions hold text (possibly empty), odd positions hold numbers. The
    side closes the key at an odd position, so against a longer name it compares
    with that name's next number.
    """
    card = F.lower(pairing_key(name))
    runs = F.regexp_extract_all(card, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    empty = F.array().cast("array<string>")
    blank = F.array(F.lit(""))
    chunks = F.concat(
        F.when(card.rlike("^[0-9]") | (card == ""), blank).otherwise(empty),
        runs,
        F.when(card.rlike(r"[0-9]\z"), blank).otherwise(empty),
    )
    keyed = F.transform(
        chunks, lambda text, i: F.when(i % 2 == 1, _number_key(text)).otherwise(text)
    )
    side_digit = F.when(F.lower(side) == "front", F.lit("0")).otherwise(F.lit("1"))
    return F.concat(keyed, F.array(_number_key(side_digit)))
