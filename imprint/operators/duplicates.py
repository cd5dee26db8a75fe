"""Duplicate search over fingerprints, and the candidate pairs it yields.

A *print row* has ``id``, ``batch_id``, ``pairing_key`` and ``prints``, an array
of (rotation, hash, colour). The query side of a pair is searched at rotation 0,
the candidate side at every rotation it has.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.config import MatchConfig
from imprint.functions.bits import hamming
from imprint.functions.color import bhattacharyya, distance_of_roots, root_shares
from imprint.operators.bands import BandPlan
from imprint.operators.blocks import BestRotations, linked_rows, print_pairs
from imprint.operators.similarity import all_pairs_cheaper, hash_pairs
from imprint.operators.skew import chunked_join
from imprint.session import materialize


def print_at(prints: Column, rotation: int) -> Column:
    """Fingerprint at one rotation, NULL if there is none."""
    return F.get(F.filter(prints, lambda p: p["rotation"] == rotation), F.lit(0))


def best_match(
    query_hash: Column, query_color: Column, prints: Column, config: MatchConfig = MatchConfig()
) -> Column:
    """Struct (structural, rotation, color) of the best rotation, or NULL.

    Least Hamming distance wins, then the earlier rotation. Both bounds hold at
    that rotation. The colour test is reached only by prints inside the radius; a
    NaN sorts above every bound and fails it.
    """
    near = F.filter(
        prints,
        lambda p: p["color"].isNotNull() & (hamming(query_hash, p["hash"]) <= config.structural_max),
    )
    scored = F.transform(
        near,
        lambda p: F.struct(
            hamming(query_hash, p["hash"]).alias("structural"),
            p["rotation"].alias("rotation"),
            bhattacharyya(query_color, p["color"]).alias("color"),
        ),
    )
    return F.array_min(
        F.filter(scored, lambda s: s["color"] <= config.color_max)
    )


@dataclass(frozen=True)
class BestMatch:
    """``best_match`` as the test of pairs of ``hamming_join``.

    Names the columns of the query's hash and colour and of the other row's prints. Pairs
    made block by block are tested in arrays of the two blocks, others by the column.
    """

    query_hash: str
    query_color: str
    prints: str
    config: MatchConfig = MatchConfig()

    @property
    def left(self) -> list[str]:
        return [self.query_hash, self.query_color]

    @property
    def right(self) -> list[str]:
        return [self.prints]

    def column(self) -> Column:
        return best_match(*(F.col(f"left_{c}") for c in self.left), F.col(f"right_{self.prints}"), self.config)

    def type(self, right: T.StructType) -> T.StructType:
        rotation = right[f"right_{self.prints}"].dataType.elementType["rotation"].dataType
        return T.StructType().add("structural", T.IntegerType()).add("rotation", rotation).add("color", T.DoubleType())

    def arrays(self, one: pa.Table, other: pa.Table) -> BestRotations:
        columns = [*(one.column(f"left_{c}") for c in self.left), other.column(f"right_{self.prints}")]
        return BestRotations(*columns, self.config.structural_max, self.config.color_max)


@dataclass(frozen=True)
class FoldedPrints:
    """Rows folded by fingerprint, so that copies are searched once.

    ``members`` has every row with its ``print_key``; ``prints`` has one row per key
    and rotation, with the ``least`` and ``most`` id among its ``arrived`` rows and
    whether there are ``old`` ones. ``arrived`` marks rows, and prints of rows, that
    are to be matched; the others are history, which is only matched against. ``one`` of
    a print, if there, is its row where it has only one, and ``repeated`` the number of
    keys that have several.
    """

    members: DataFrame
    prints: DataFrame
    by: list[str]
    repeated: int | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.by, "print_key"]


#: Print keys with several rows that may be sent to every task, about 70 bytes each.
_SENT_KEYS = 500_000
#: Prints that may be sent to every task to leave the colours of others out.
_SENT_PRINTS = 500_000


def with_print_key(rows: DataFrame) -> DataFrame:
    """Add the key that rows with equal fingerprints share."""
    return rows.withColumn("print_key", F.unhex(F.sha2(F.to_json("prints"), 256)))


def _repeated_keys(keyed: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """Print keys with several rows, and how many there are."""
    ids = lambda f, flag: f(F.when(flag, F.col("id")))
    several = materialize(
        keyed.groupBy(*by, "print_key").agg(
            F.count(F.lit(1)).alias("_rows"), F.min("id").alias("_first"),
            ids(F.min, F.col("arrived")).alias("_least"), ids(F.max, F.col("arrived")).alias("_most"),
            F.bool_or(~F.col("arrived")).alias("_old"),
        ).filter("_rows > 1").drop("_rows")
    )
    return several, several.count()


def turned_prints(keyed: DataFrame, by: list[str], repeated: tuple[DataFrame, int] | None = None) -> DataFrame:
    """One row per print key and rotation, of rows with ``print_key`` and ``arrived``; other columns are kept.

    Only keys with several rows are looked at together, so the fingerprints stay in
    place: the row of least id has them, and the others are left out. ``one`` is the row
    of a key that has no other.
    """
    several, count = repeated or _repeated_keys(keyed, by)
    marks = F.broadcast(several) if count <= _SENT_KEYS else several
    alone = F.col("_first").isNull()
    own = F.when(F.col("arrived"), F.col("id"))
    row = [c for c in ("id", "batch_id", "pairing_key", "arrived") if c in keyed.columns]
    kept = keyed.join(marks, [*by, "print_key"], "left").filter(alone | (F.col("id") == F.col("_first"))).withColumns({
        "one": F.when(alone, F.struct(*row)),
        "least": F.when(alone, own).otherwise(F.col("_least")),
        "most": F.when(alone, own).otherwise(F.col("_most")),
        "old": F.when(alone, ~F.col("arrived")).otherwise(F.col("_old")),
    }).drop("_first", "_least", "_most", "_old")
    return kept.select(*[c for c in kept.columns if c != "prints"], F.inline("prints")).filter(
        F.col("hash").isNotNull() & F.col("color").isNotNull()
    )


def fold_copies(new: DataFrame, history: DataFrame | None = None, by: list[str] | None = None) -> FoldedPrints:
    """Fold rows with equal fingerprints (and equal ``by`` columns).

    Ids are unique; of rows that repeat one, each counts.
    """
    by = by or []
    rows = new.withColumn("arrived", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.withColumn("arrived", F.lit(False)))
    keyed = materialize(with_print_key(rows))
    repeated = _repeated_keys(keyed, by)
    prints = turned_prints(keyed, by, repeated).withColumn("arrived", F.col("least").isNotNull())
    columns = ["print_key", "arrived", "least", "most", "old", "rotation", "hash", "color", "one"]
    return FoldedPrints(keyed.drop("prints"), prints.select(*by, *columns), by, repeated[1])


def _print_sizes(prints: DataFrame) -> tuple[int, int, int, int, bool]:
    """Different upright hashes and their rows, different hashes and their rows, whether any is old."""
    return tuple(prints.agg(
        F.approx_count_distinct(F.when(F.col("arrived") & (F.col("rotation") == 0), F.col("hash"))),
        F.count_if(F.col("arrived") & (F.col("rotation") == 0)),
        F.approx_count_distinct("hash"),
        F.count(F.lit(1)),
        F.coalesce(F.bool_or("old"), F.lit(False)),
    ).first())


def _in_blocks(config: MatchConfig, probing: int, indexed: int) -> bool:
    return all_pairs_cheaper(BandPlan.for_sizes(config.structural_max, probing, indexed), probing, indexed)


def match_prints(
    folded: FoldedPrints, config: MatchConfig = MatchConfig(), direction: str = "later", keys: bool = True
) -> DataFrame:
    """Matching (query_key, print_key) pairs of prints that have rows to pair, one row per pair.

    This is the compact result: its size depends on the number of different
    fingerprints, not on how many rows share them. Pairs of prints without two rows
    in the right order are left out before any colour is read. Where all prints are
    compared, block by block, ``query_one`` and ``other_one`` are the rows of prints that
    have only one, and without ``keys`` the keys are left out.
    """
    by, prints = folded.by, folded.prints
    upright = prints.filter(F.col("arrived") & (F.col("rotation") == 0))
    probing, probing_rows, indexed, indexed_rows, history = _print_sizes(prints)
    if _in_blocks(config, probing, indexed):
        carried = [c for c in ("key", "one") if c in ("key" if keys else "", *prints.columns)]
        pairs = print_pairs(
            prints.withColumnRenamed("print_key", "key"), max(probing_rows, indexed_rows // 4),
            config.structural_max, config.color_max, direction, by, carried, history,
        )
        named = [F.col("query_key"), F.col("other_key").alias("print_key")] if keys else []
        return pairs.select(
            *by, *named, "color", F.expr("cast(rank div 360 as int)").alias("structural"),
            F.expr("cast(rank % 360 as int)").alias("rotation"), *[f"{s}_one" for s in ("query", "other") if "one" in carried],
        )
    near = hash_pairs(
        upright, prints, config.structural_max,
        by=by, sizes=(probing, indexed), split_rows=config.split_rows,
    )
    # Written, so that its true size decides how the fingerprints are joined to it.
    near = materialize(near)
    left = upright.select(
        *by, F.col("hash").alias("left_hash"), F.col("print_key").alias("query_key"),
        F.col("least").alias("query_least"), F.col("most").alias("query_most"),
    )
    right = prints.select(*by, F.col("hash").alias("right_hash"), "print_key", "rotation", "least", "most", "old")
    hits = chunked_join(near, left, [*by, "left_hash"], "query_key", config.split_rows, probing_rows)
    hits = chunked_join(hits, right, [*by, "right_hash"], "print_key", config.split_rows, indexed_rows)
    ordered = F.col("query_most") > F.col("least")
    if direction == "either":
        ordered = ordered | (F.col("query_least") < F.col("most"))
    # A print with one row is no pair with itself, whatever its rotations.
    hits = materialize(
        hits.filter(F.col("old") | F.coalesce(ordered, F.lit(False)))
        .select(*by, "query_key", "print_key", "rotation", "distance")
    )
    colored = prints.select(*by, "print_key", "rotation", "arrived", "color")
    wanted = hits.select(*by, "print_key").union(hits.select(*by, F.col("query_key").alias("print_key"))).distinct()
    if wanted.count() <= _SENT_PRINTS:
        # So few that the colours of all others stay where they are.
        colored = colored.join(F.broadcast(wanted), [*by, "print_key"], "left_semi")
    query_colors = colored.filter(F.col("arrived") & (F.col("rotation") == 0)).select(
        *by, F.col("print_key").alias("query_key"), root_shares(F.col("color")).alias("query_color")
    )
    print_colors = colored.select(*by, "print_key", "rotation", root_shares(F.col("color")).alias("print_color"))
    scored = (
        hits.join(query_colors, [*by, "query_key"])
        .join(print_colors, [*by, "print_key", "rotation"])
        .withColumn("color", distance_of_roots(F.col("query_color"), F.col("print_color")))
        .filter(F.col("color") <= config.color_max)
    )
    # One number orders (distance, rotation), which keeps this a hash aggregate.
    rank = (F.col("distance") * 360 + F.col("rotation")).cast("int")
    return (
        scored.groupBy(*by, "query_key", "print_key")
        .agg(F.min(rank).alias("rank"), F.min_by("color", rank).alias("color"))
        .select(
            *by, "query_key", "print_key", "color",
            F.expr("cast(rank div 360 as int)").alias("structural"),
            F.expr("cast(rank % 360 as int)").alias("rotation"),
        )
    )


def expand_matches(
    matches: DataFrame, folded: FoldedPrints, config: MatchConfig = MatchConfig(), direction: str = "later"
) -> DataFrame:
    """Row-level hits of matching prints.

    A new row is matched against all of history, and among new rows the larger id
    is the query ('later') or either one ('either'). The members of a hot print
    are joined in chunks, so its copies are spread over many tasks.
    """
    by, members = folded.by, folded.members
    rules = {
        "later": ~F.col("other_arrived") | (F.col("query_id") > F.col("other_id")),
        "either": F.col("query_id") != F.col("other_id"),
    }
    if direction not in rules:
        raise ValueError("direction must be 'later' or 'either'")
    if "query_one" in matches.columns:
        if folded.repeated:
            matches = materialize(matches)
        alone = F.col("query_one").isNotNull() & F.col("other_one").isNotNull()
        carried = [c for c in ("id", "batch_id", "pairing_key") if c not in by]
        single = (
            matches.filter(alone).select(
                *by, "color", "structural", "rotation",
                *[F.col(f"{s}_one")[c].alias(f"{s}_{c}") for s in ("query", "other") for c in carried],
                F.col("other_one")["arrived"].alias("other_arrived"),
            ).filter(rules[direction]).drop("other_arrived")
        )
        if folded.repeated == 0:
            return single
        rest = matches.filter(~alone).drop("query_one", "other_one")
        return single.unionByName(expand_matches(rest, folded, config, direction))
    total = members.count()

    def side(name: str, key: str, rows: DataFrame) -> DataFrame:
        carried = [c for c in ("id", "batch_id", "pairing_key", "arrived") if c not in by]
        return rows.select(
            *by, F.col("print_key").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in carried]
        )

    queries = side("query", "query_key", members.filter("arrived")).drop("query_arrived")
    others = side("other", "print_key", members)
    hits = chunked_join(matches, queries, [*by, "query_key"], "query_id", config.split_rows, total)
    hits = chunked_join(hits, others, [*by, "print_key"], "other_id", config.split_rows, total)
    return hits.filter(rules[direction]).drop("query_key", "print_key", "other_arrived")


def within_batch_hits(
    rows: DataFrame, config: MatchConfig = MatchConfig(), direction: str = "later"
) -> DataFrame:
    """Hits between rows of one batch; the batch is part of every join key."""
    folded = fold_copies(rows, by=["batch_id"])
    hits = expand_matches(match_prints(folded, config, direction, keys=bool(folded.repeated)), folded, config, direction)
    return hits.withColumns(
        {"query_batch_id": F.col("batch_id"), "other_batch_id": F.col("batch_id")}
    ).drop("batch_id")


def cross_batch_hits(
    rows: DataFrame, config: MatchConfig = MatchConfig(), direction: str = "later"
) -> DataFrame:
    """Hits between rows of different batches."""
    return all_hits(rows, config=config, direction=direction).filter(
        F.col("query_batch_id") != F.col("other_batch_id")
    )


def all_hits(
    rows: DataFrame,
    history: DataFrame | None = None,
    config: MatchConfig = MatchConfig(),
    direction: str = "later",
) -> DataFrame:
    """Within-batch and cross-batch hits of new rows from a single search.

    With ``history`` the new rows are also matched against it; history is never
    matched against itself.
    """
    folded = fold_copies(rows, history)
    return expand_matches(match_prints(folded, config, direction, keys=bool(folded.repeated)), folded, config, direction)


def ids_once(*tables: DataFrame | None) -> bool:
    """Whether every row of the tables has an id that no other has."""
    ids = [t.select("id") for t in tables if t is not None]
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    rows, distinct = every.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    return rows == distinct


def canonical_pairs(hits: DataFrame, once: bool = False) -> DataFrame:
    """One row per unordered pair, smaller id first, with its best scores.

    ``filename_match`` says whether both names share a pairing key. ``once`` says that
    no pair comes twice in either order, as under direction 'later' with ids that occur
    once; then no row need be compared with others.
    """
    a, b = F.least("query_id", "other_id"), F.greatest("query_id", "other_id")
    same_key = F.col("query_pairing_key").eqNullSafe(F.col("other_pairing_key"))
    same_batch = F.col("query_batch_id") == F.col("other_batch_id")
    if once:
        return hits.select(
            a.alias("card_crop_id_a"), b.alias("card_crop_id_b"), F.col("structural").cast("double").alias("structural_score"),
            F.col("color").alias("color_score"), F.col("rotation").alias("matched_rotation"),
            same_key.alias("filename_match"), same_batch.alias("same_batch"),
        )
    rank = (F.col("structural") * 360 + F.col("rotation")).cast("int")
    return (
        hits.groupBy(a.alias("card_crop_id_a"), b.alias("card_crop_id_b"))
        .agg(
            F.min(rank).alias("rank"),
            F.min_by("color", rank).alias("color_score"),
            F.bool_or(same_key).alias("filename_match"),
            F.bool_or(same_batch).alias("same_batch"),
        )
        .select(
            "card_crop_id_a",
            "card_crop_id_b",
            F.expr("cast(rank div 360 as double)").alias("structural_score"),
            "color_score",
            F.expr("cast(rank % 360 as int)").alias("matched_rotation"),
            "filename_match",
            "same_batch",
        )
    )


def insert_if_absent(pairs: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Pairs not yet recorded, in whatever status: a rejected pair stays away."""
    if existing is None:
        return pairs
    known = existing.select("card_crop_id_a", "card_crop_id_b")
    return pairs.join(known, ["card_crop_id_a", "card_crop_id_b"], "left_anti")


def emit_candidates(pairs: DataFrame) -> DataFrame:
    """New candidate rows, waiting for a decision."""
    return pairs.select(
        "card_crop_id_a", "card_crop_id_b", "structural_score", "color_score",
        "matched_rotation", "filename_match", F.lit("pending").alias("status"),
    )


def matched_ids(hits: DataFrame, once: bool = False) -> DataFrame:
    """Distinct matched rows per query row, over all rotations; ``once`` says that no pair comes twice."""
    pairs = hits.select("query_id", "other_id")
    return pairs if once else pairs.dropDuplicates()


@dataclass(frozen=True)
class DuplicateClasses:
    """Duplicates without a row for every pair: n copies take n rows.

    ``members`` has every row with the ``class_id`` of its print, the least id that
    has it. ``pairs`` has the matching classes, ``class_a`` < ``class_b``, with the best
    scores of either direction, and each class that matches itself under both names.
    ``links``, if there, has the number of rows linked to each class, counted without pairs.
    """

    members: DataFrame
    pairs: DataFrame
    by: list[str]
    links: DataFrame | None = None

    def rows(self) -> DataFrame:
        """Every row with its class, the rows of the class, and the number of other rows that are linked to it."""
        by = self.by
        sizes = materialize(self.members.groupBy(*by, "class_id").agg(F.count(F.lit(1)).alias("class_size")))
        linked = self._linked(sizes) if self.links is None else self.links
        totals = sizes.join(linked, [*by, "class_id"], "left").select(
            *by, "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
        )
        return self.members.join(totals, [*by, "class_id"]).select("id", "batch_id", "class_id", "class_size", "links")

    def _linked(self, sizes: DataFrame) -> DataFrame:
        by = self.by
        both = self.pairs.select(*by, F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).union(
            self.pairs.filter("class_a <> class_b").select(*by, "class_b", "class_a")
        )
        others = sizes.select(*by, F.col("class_id").alias("other"), F.col("class_size").alias("other_size"))
        return both.join(others, [*by, "other"]).groupBy(*by, "class_id").agg(
            F.sum(F.col("other_size") - F.when(F.col("other") == F.col("class_id"), 1).otherwise(0)).alias("links")
        )

    def expand(self, split_rows: int = MatchConfig().split_rows) -> DataFrame:
        """A row for every linked pair of rows: id_a < id_b and the scores of their classes."""
        total, pairs = self.members.count(), self.pairs
        for side in ("a", "b"):
            rows = self.members.select(*self.by, F.col("class_id").alias(f"class_{side}"), F.col("id").alias(f"id_{side}"))
            pairs = chunked_join(pairs, rows, [*self.by, f"class_{side}"], f"id_{side}", split_rows, total)
        kept = (F.col("class_a") != F.col("class_b")) | (F.col("id_a") < F.col("id_b"))
        return pairs.filter(kept).select(
            F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "structural", "rotation", "color"
        )


def duplicate_classes(rows: DataFrame, config: MatchConfig = MatchConfig(), by: list[str] | None = None) -> DuplicateClasses:
    """Classes of rows with equal prints, and which classes match in either direction.

    With ``by=["batch_id"]`` only rows of one batch are compared. Rows without a
    print, and those with an empty histogram, are classes that match nothing.
    """
    by = by or []
    folded = fold_copies(rows, by=by)
    members = folded.members
    names = members.groupBy(*by, "print_key").agg(F.min("id").alias("class_id"))
    named = materialize(members.join(names, [*by, "print_key"]).select(*dict.fromkeys([*by, "id", "batch_id", "print_key", "class_id"])))
    keys = named.filter("id = class_id").select(*by, "print_key", "class_id")
    matches = match_prints(folded, config, "either").select(*by, "query_key", "print_key", "color", "structural", "rotation")
    a = keys.select(*by, F.col("print_key").alias("query_key"), F.col("class_id").alias("query_class"))
    b = keys.select(*by, "print_key", F.col("class_id").alias("other_class"))
    met = matches.join(a, [*by, "query_key"]).join(b, [*by, "print_key"])
    rank = (F.col("structural") * 360 + F.col("rotation")).cast("int")
    pairs = (
        met.groupBy(*by, F.least("query_class", "other_class").alias("class_a"), F.greatest("query_class", "other_class").alias("class_b"))
        .agg(F.min(rank).alias("rank"), F.min_by("color", rank).alias("color"))
        .select(
            *by, "class_a", "class_b", F.expr("cast(rank div 360 as int)").alias("structural"),
            F.expr("cast(rank % 360 as int)").alias("rotation"), "color",
        )
    )
    probing, probing_rows, indexed, indexed_rows, _ = _print_sizes(folded.prints)
    if not _in_blocks(config, probing, indexed):
        return DuplicateClasses(named.drop("print_key"), materialize(pairs), by)
    sizes = named.groupBy(*by, "class_id").agg(F.count(F.lit(1)).alias("size"))
    classes = keys.distinct().join(sizes, [*by, "class_id"]).withColumnRenamed("class_id", "key")
    prints = folded.prints.drop("one").join(classes, [*by, "print_key"])
    links = linked_rows(prints, max(probing_rows, indexed_rows // 4), config.structural_max, config.color_max, by)
    # Pairs are made when they are asked for, and not to count the links.
    return DuplicateClasses(named.drop("print_key"), pairs, by, links.withColumnRenamed("key", "class_id"))
