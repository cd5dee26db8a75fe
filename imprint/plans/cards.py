"""Card and batch pages for many ids at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions import naming
from imprint.functions.keys import public_url
from imprint.functions.numeric import finite_or_null
from imprint.operators.catalog import pair_history, scan_listing
from imprint.operators.review import card_sides
from imprint.operators.status import crops_with_scans


def card_detail(
    wanted: DataFrame, crops: DataFrame, scans: DataFrame, candidates: DataFrame, url_base: str
) -> tuple[DataFrame, DataFrame]:
    """(cards, history) of the wanted crops (``id``).

    A card row has the addresses of both its sides; the history has one row per
    crop and candidate pair, with both crops of the pair and both sides of their
    cards (``a_`` and ``b_``: batch, name, side, address, front and back address).
    """
    cards = crops_with_scans(crops, scans)
    keys = crops.select(F.col("id"), "r2_key_cropped")

    def side_key(name: str) -> DataFrame:
        return keys.select(F.col("id").alias(f"{name}_id"), F.col("r2_key_cropped").alias(f"{name}_key"))

    sided = (
        cards.join(card_sides(cards), ["batch_id", "pairing_key"], "left")
        # The crop itself stands for its own side.
        .withColumns(
            {
                "front_id": F.when(F.col("side") == "front", F.col("id")).otherwise(F.col("front_id")),
                "back_id": F.when(F.col("side") == "back", F.col("id")).otherwise(F.col("back_id")),
            }
        )
        .join(side_key("front"), "front_id", "left")
        .join(side_key("back"), "back_id", "left")
    )
    urls = {"image_url": "r2_key_cropped", "front_image_url": "front_key", "back_image_url": "back_key"}
    detail = (
        sided.withColumns({url: public_url(F.col(key), url_base) for url, key in urls.items()})
        .drop("front_key", "back_key").join(wanted.select("id"), "id", "left_semi")
    )
    # Pairs travel with keys, not addresses, and with no key twice.
    own = {f"{s}_own": F.col(f"{s}_key").eqNullSafe(F.col("r2_key_cropped")) for s in ("front", "back")}
    carried = sided.withColumns(own).withColumns({f"{s}_key": F.when(~F.col(f"{s}_own"), F.col(f"{s}_key")) for s in ("front", "back")})
    carried = carried.select("id", "batch_id", "original_filename", "side", "r2_key_cropped", "front_key", "front_own", "back_key", "back_own")
    every = wanted is crops
    if every:
        # Most pairs have a wanted crop, so each is joined once and dealt to its crops at the end.
        history = candidates.withColumnRenamed("id", "candidate_id")
        carried = carried.join(wanted.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("times")), "id", "full")
    else:
        history = pair_history(wanted, candidates)
    for end in ("a", "b"):
        named = carried.select(F.col("id").alias(f"card_crop_id_{end}"), *[F.col(c).alias(f"{end}_{c}") for c in carried.columns if c != "id"])
        history = history.join(named, f"card_crop_id_{end}", "left")
    if every:
        a, b = F.col("card_crop_id_a"), F.col("card_crop_id_b")
        times = {e: F.coalesce(f"{e}_times", F.lit(0)) for e in ("a", "b")}
        again = F.when(a.eqNullSafe(b), F.lit(0)).otherwise(times["b"])
        history = history.withColumn("crop_id", F.explode(F.concat(F.array_repeat(a, times["a"]), F.array_repeat(b, again))))
    for end in ("a", "b"):
        image = F.col(f"{end}_r2_key_cropped")
        history = history.withColumns(
            {
                f"{end}_image_url": public_url(image, url_base),
                **{
                    f"{end}_{s}_image_url": public_url(F.when(F.col(f"{end}_{s}_own"), image).otherwise(F.col(f"{end}_{s}_key")), url_base)
                    for s in ("front", "back")
                },
            }
        ).drop(f"{end}_r2_key_cropped", f"{end}_times", *[f"{end}_{s}_{x}" for s in ("front", "back") for x in ("key", "own")])
    shown = ["batch_id", "original_filename", "side", *urls]
    ends = [f"{end}_{c}" for end in ("a", "b") for c in shown]
    history = history.withColumns({c: finite_or_null(F.col(c)) for c in ("structural_score", "color_score")})
    return detail, history.select(*[c for c in history.columns if c not in ends], *ends)


def batch_listing(
    wanted: DataFrame, scans: DataFrame, crops: DataFrame, candidates: DataFrame, url_base: str
) -> DataFrame:
    """Scans of the wanted batches (``id``) in natural name order."""
    chosen = scans.join(wanted.select(F.col("id").alias("batch_id")), "batch_id", "left_semi")
    listed = scan_listing(chosen, crops, candidates, url_base)
    key = naming.natural_key(F.col("original_filename"), F.col("side"))
    return listed.withColumn("sort_key", key).orderBy("batch_id", "sort_key", "id")
