import random

import pytest
from pyspark.sql import functions as F

from imprint.operators import geometry


@pytest.mark.parametrize(
    "width, height, tolerance, ok, side",
    [
        (125.0, 175.0, 0.15, True, "portrait"),
        (200.0, 200.0, 0.15, False, "landscape"),
        (175.0, 125.0, 0.15, True, "landscape"),
        (900.0, 1100.0, 0.15, False, "portrait"),
        (900.0, 1100.0, 0.35, True, "portrait"),
        (600.0, 600.0, 0.35, False, "landscape"),
        (100.0, 0.0, 0.35, False, "landscape"),
    ],
)
def test_gate(spark, width, height, tolerance, ok, side):
    w, h = F.lit(width), F.lit(height)
    row = spark.range(1).select(
        geometry.aspect_ok(geometry.aspect_ratio(w, h), tolerance).alias("ok"), geometry.orientation(w, h).alias("side")
    ).first()
    assert (row.ok, row.side) == (ok, side)


def plain_best(rows, frame):
    candidates = [r for r in rows if r[4] >= frame * 0.005]
    if not candidates:
        return None
    largest = int(max(r[4] for r in candidates))

    def score(r):
        w, h, area = r[2:5]
        if w <= 0 or h <= 0:
            return (float("inf"), 0.0)
        return (abs(max(w, h) / min(w, h) - 1.4) + (1 - area / max(1, largest)) * 0.5, area / max(1, frame))

    return min(candidates, key=score)[1]


def test_best_detection_equals_the_plain_loop(spark):
    rng = random.Random(6)
    rows = []
    for image in range(40):
        for ordinal in range(rng.randint(1, 6)):
            w, h = rng.choice([0.0, 100.0, 140.0, 200.0]), rng.choice([100.0, 140.0, 280.0])
            rows.append((image, ordinal, w, h, rng.choice([10.0, 5000.0, 9000.0, 20000.5])))
    df = spark.createDataFrame(rows, "image long, ordinal long, width double, height double, area double").withColumns(
        {"image_width": F.lit(1000), "image_height": F.lit(1000)}
    )
    got = {r.image: r.ordinal for r in geometry.best_detection(df).collect()}
    expected = {i: plain_best([r for r in rows if r[0] == i], 1_000_000) for i in range(40)}
    assert got == {i: o for i, o in expected.items() if o is not None}


def test_corners_sides_and_area(spark):
    points = [[100.0, 110.0], [10.0, 100.0], [10.0, 10.0], [100.0, 10.0]]
    df = spark.createDataFrame([(points,)], "p array<array<double>>")
    corners = geometry.order_corners(F.col("p"))
    row = df.select(
        corners.alias("c"), geometry.crop_box(F.col("p")).alias("box"), geometry.polygon_area(corners).alias("area"),
        geometry.clip_points(F.col("p"), F.lit(50), F.lit(60)).alias("clipped"),
    ).first()
    assert row.c == [[10.0, 10.0], [100.0, 10.0], [100.0, 110.0], [10.0, 100.0]]
    assert row.area == pytest.approx(90 * 95)
    assert row.box.orientation == "portrait" and row.box.points == row.c
    assert row.clipped[0] == [49.0, 59.0]


def test_equal_corners_take_the_first_point(spark):
    points = [[0.0, 0.0], [0.0, 0.0], [5.0, 5.0], [5.0, 5.0]]
    row = spark.createDataFrame([(points,)], "p array<array<double>>").select(geometry.order_corners(F.col("p")).alias("c")).first()
    assert row.c == [[0.0, 0.0], [0.0, 0.0], [5.0, 5.0], [0.0, 0.0]]


def test_frame_box_and_canvas(spark):
    row = spark.range(1).select(
        geometry.frame_box(F.lit(750), F.lit(1050)).alias("b"), geometry.output_canvas(F.lit("landscape")).alias("c")
    ).first()
    assert row.b.points[2] == [749.0, 1049.0] and row.b.orientation == "portrait"
    assert row.b.aspect_ratio == pytest.approx(1.4)
    assert (row.c.width, row.c.height) == (1050, 750)


def test_crop_outcome(spark):
    scans = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending")], "id long, status string")
    checks = spark.createDataFrame([(1, True), (2, False)], "scan_id long, aspect_ratio_ok boolean")
    got = {r.id: (r.status, r.has_crop) for r in geometry.crop_outcome(scans, checks).collect()}
    assert got == {1: ("cropped", True), 2: ("crop_failed", True), 3: ("crop_failed", False)}
