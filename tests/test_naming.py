import random
import re

import pytest
from pyspark.sql import functions as F

from imprint.functions import naming
from imprint.operators import intake


@pytest.mark.parametrize(
    "name, side, key",
    [
        ("12345-front.jpg", "front", "12345"),
        ("ABC-BACK.PNG", "back", "abc"),
        ("randomfile.jpg", None, "randomfile.jpg"),
        ("Plain.JPG", None, "Plain.JPG"),
        ("a-front-back.jpg", "back", "a-front"),
        ("x-front.tar.jpg", None, "x-front.tar.jpg"),
        ("-front.jpg", None, "-front.jpg"),
    ],
)
def test_side_and_pairing_key(spark, name, side, key):
    row = spark.range(1).select(
        naming.parse_side(F.lit(name)).alias("side"), naming.pairing_key(F.lit(name)).alias("key")
    ).first()
    assert (row.side, row.key) == (side, key)


def natural_tuple(key, side):
    chunks = [int(c) if c.isdigit() else c for c in re.split(r"(\d+)", key.lower())]
    return (*chunks, 0 if side == "front" else 1)


def test_natural_key_orders_like_the_tuple(spark):
    rng = random.Random(5)
    stems = ["a", "a0", "card-2", "card-10", "card-010", "#x", "10", "9", "é2", "card", "0a", "a00b1"]
    stems += ["".join(rng.choice("ab0129-#") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = [(i, f"{s}-{side}.jpg", s, side) for i, (s, side) in enumerate((s, d) for s in stems for d in ("front", "back"))]
    df = spark.createDataFrame(rows, "id int, name string, stem string, side string")
    got = [r.id for r in df.orderBy(naming.natural_key(F.col("name"), F.col("side")), "id").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (natural_tuple(r[2], r[3]), r[0]))]


def test_side_compares_with_a_number_of_a_longer_name(spark):
    df = spark.createDataFrame([("a-back.jpg", "back"), ("a0-front.jpg", "front")], "name string, side string")
    ordered = [r.name for r in df.orderBy(naming.natural_key(F.col("name"), F.col("side"))).collect()]
    assert ordered == ["a0-front.jpg", "a-back.jpg"]


def test_safe_label(spark):
    df = spark.createDataFrame([(1, "Lot 7/ä: x"), (2, ""), (3, None), (4, " a_b ")], "id long, label string")
    got = {r.id: r.l for r in df.select("id", naming.safe_label(F.col("label"), F.col("id")).alias("l")).collect()}
    assert got == {1: "Lot 7_ä_ x", 2: "batch_2", 3: "batch_3", 4: "a_b"}


def test_classification_keeps_the_first_of_a_hot_name(spark):
    names = ["a-front.jpg"] * 2000 + ["A-FRONT.JPG", "noext", "x.gif", "y.jpg", "d/b-back.png", "b-back.PNG"]
    entries = spark.createDataFrame([("z", i, n, 10) for i, n in enumerate(names)], "archive string, ordinal long, path string, size long")
    classified = intake.classify_entries(entries)
    got = {r.ordinal: r.outcome for r in classified.collect()}
    assert got[0] == "supported" and set(got[i] for i in range(1, 2001)) == {"duplicate"}
    assert [got[i] for i in range(2001, 2006)] == ["unsupported", "unsupported", "unmatched_naming", "supported", "duplicate"]
    summary = intake.intake_summary(classified).first()
    assert (summary.supported_images, summary.duplicate_entries, summary.uncompressed_size) == (2, 2001, 20060)
