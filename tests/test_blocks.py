import random

import pytest
from pyspark.sql import functions as F

from imprint import MatchConfig
from imprint.operators import blocks, duplicates, similarity
from imprint.operators.bands import BandPlan
from tests.test_duplicates import BLUE, RED, SCHEMA, card

CONFIG = MatchConfig(structural_max=24, color_max=0.5)


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "_LEAST", 25)


def cards(n, seed=5):
    draw = random.Random(seed)
    rows = [card(i, i % 3, [draw.getrandbits(64) for _ in range(4)], draw.choice([RED, BLUE, [0.5] * 8]), f"k{i % 4}") for i in range(n)]
    # Copies, a row without an id, one without prints.
    return rows + [(1000 + i, 5 - i, "c", rows[3][3]) for i in range(3)] + [(None, 1, "n", rows[4][3]), (2000, 1, "u", None)]


def hits_of(spark, monkeypatch, rows, history, direction, dense):
    monkeypatch.setattr(similarity, "_CELL_COST", 0.0 if dense else 1e9)
    hits = duplicates.all_hits(rows, history, CONFIG, direction)
    columns = ["query_id", "other_id", "query_batch_id", "other_batch_id", "query_pairing_key", "other_pairing_key", "structural", "rotation"]
    return sorted([(*[r[c] for c in columns], round(r.color, 9)) for r in hits.collect()], key=repr)


@pytest.mark.parametrize("direction", ["later", "either"])
@pytest.mark.parametrize("with_history", [False, True])
def test_blocks_find_what_bands_find(spark, monkeypatch, small_blocks, direction, with_history):
    made = cards(60)
    rows = spark.createDataFrame(made, SCHEMA)
    history = None
    if with_history:
        history, rows = (spark.createDataFrame([r for i, r in enumerate(made) if i % 2 == k], SCHEMA) for k in (0, 1))
    dense, bands = (hits_of(spark, monkeypatch, rows, history, direction, d) for d in (True, False))
    assert dense == bands and len(dense) > 30


def test_pairs_are_not_shuffled(spark, small_blocks):
    rows = spark.createDataFrame(cards(60)[:60], SCHEMA)
    plan = duplicates.all_hits(rows, config=CONFIG)._jdf.queryExecution().executedPlan().toString()
    # The rows are dealt to blocks below the comparison; its pairs go on as they are.
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


@pytest.mark.parametrize("by", [[], ["batch_id"]])
def test_links_are_counted_without_pairs(spark, monkeypatch, small_blocks, by):
    rows = spark.createDataFrame(cards(60), SCHEMA)
    got = []
    for cost in (0.0, 1e9):
        monkeypatch.setattr(similarity, "_CELL_COST", cost)
        classes = duplicates.duplicate_classes(rows, CONFIG, by)
        assert (classes.links is not None) == (cost == 0.0)
        got.append(sorted(tuple(r) for r in classes.rows().na.fill(-1).collect()))
    assert got[0] == got[1] and any(r[-1] > 0 for r in got[0])


def test_nearest_hash_of_each_id(spark, monkeypatch, small_blocks):
    draw = random.Random(2)
    made = [(i // 3, draw.getrandbits(64) - (1 << 63), f"x{i // 3}") for i in range(90)] + [(None, 0, "none"), (50, None, "x50")]
    df = spark.createDataFrame(made, "id long, hash long, name string")
    expected = {}
    for i, a, _ in made:
        for j, b, name in made:
            if None not in (i, j, a, b) and distance(a, b) <= 24:
                expected[(i, j, name)] = min(distance(a, b), expected.get((i, j, name), 64))
    for cost in (0.0, 1e9):
        monkeypatch.setattr(similarity, "_CELL_COST", cost)
        joined = similarity.hamming_join(df, df, 24, nearest="id", right_columns=["name"])
        rows = joined.collect()
        assert {(r.left_id, r.right_id, r.right_name): r.distance for r in rows} == expected and len(rows) == len(expected)
        near = similarity.near_hashes(df.filter("id = 1"), df, 24, sizes=(3, 90))
        assert {r.hash for r in near.collect()} == {b for _, b, _ in made if b is not None and any(i == 1 and distance(a, b) <= 24 for i, a, _ in made)}


def odd_prints(n, seed=7):
    draw = random.Random(seed)
    colors = [[0.5, 0.5, 0.0], [0.1, 0.2, 0.7], [0.0, 1.0, 0.0], [0.4, 0.6], [], [0.0, 0.0, 0.0], [0.3, None, 0.7], [float("nan"), 1.0, 0.0], [-1.0, -2.0, -3.0], None]
    rows = []
    for i in range(n):
        base = draw.getrandbits(64)
        prints = [
            (draw.choice([0, 90, 180, None]), draw.choice([None] + [base ^ draw.getrandbits(64) & draw.getrandbits(64)] * 9), draw.choice(colors))
            for _ in range(draw.randrange(6))
        ]
        signed = [(r, h if h is None else h - (h >> 63 << 64), c) for r, h, c in prints]
        rows.append((i, signed[0][1] if signed else None, draw.choice(colors), draw.choice([signed] * 9 + [[*signed, None], None])))
    # Rotations at one distance, and copies of a rotation in other colours.
    tied = [(180, 5, colors[0]), (90, 5, colors[1]), (90, 5, colors[0]), (None, 6, colors[0])]
    return rows + [(n + i, 5 + i, colors[i], tied) for i in range(3)]


def test_best_match_of_blocks_is_that_of_the_column(spark, monkeypatch, small_blocks):
    kind = "id long, hash long, c array<float>, prints array<struct<rotation: int, hash: long, color: array<float>>>"
    df = spark.createDataFrame(odd_prints(70), kind)
    turned = df.select("id", "prints", F.explode("prints.hash").alias("hash"))
    a, b = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side in ("left", "right"))
    every = a.crossJoin(b).select("left_id", "right_id", duplicates.best_match(F.col("left_hash"), F.col("left_c"), F.col("right_prints"), CONFIG).alias("match"))
    # A NaN differs from itself, and none is within the bound.
    expected = {(r.left_id, r.right_id): (r.match.structural, r.match.rotation, round(r.match.color, 9)) for r in every.collect() if r.match}
    assert len(expected) > 50 and len({v[1] for v in expected.values()}) == 4
    best = duplicates.BestMatch("hash", "c", "prints", CONFIG)
    for cost in (0.0, 1e9):
        monkeypatch.setattr(similarity, "_CELL_COST", cost)
        rows = similarity.hamming_join(df.select("id", "hash", "c"), turned, 24, nearest="id", verify=best).collect()
        assert {(r.left_id, r.right_id): (r.match.structural, r.match.rotation, round(r.match.color, 9)) for r in rows} == expected
        assert len(rows) == len(expected)


def test_best_rotation_tests_pairs_where_they_are_made(spark, monkeypatch, tmp_path):
    from __spark_entry__ import QUERIES

    monkeypatch.setattr(similarity, "_CELL_COST", 0.0)
    draw = random.Random(3)
    made = [(i, [draw.random() for _ in range(64)], i % 3) for i in range(40)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["best_rotation"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Prints are sent with the rows of a block; no pair has them, and none is tested row by row.
    assert "prints" not in plan[: plan.index("FlatMapGroupsInArrow")] and "lambda" not in plan[: plan.index("FlatMapGroupsInArrow")]
    assert found.columns == ["query_id", "other_id", "structural", "rotation", "color"] and found.count() > 0


def test_wide_radius_is_compared_in_blocks():
    assert similarity.all_pairs_cheaper(BandPlan.for_sizes(20, 600_000, 2_400_000), 600_000, 2_400_000)
    assert not similarity.all_pairs_cheaper(BandPlan.for_sizes(10, 3_000_000, 3_000_000), 3_000_000, 3_000_000)
