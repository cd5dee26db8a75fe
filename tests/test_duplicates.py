import math
import random

import pytest
from pyspark.sql import functions as F

from imprint import MatchConfig
from imprint.functions.color import bhattacharyya
from imprint.operators import duplicates
from imprint.plans.duplicates import find_duplicates

SCHEMA = "id long, batch_id long, pairing_key string, prints array<struct<rotation:int,hash:long,color:array<float>>>"
A, CLOSE, FAR = 0xF0F0F0F0F0F0F0F0, 0xF0F0F0F0F0F0F0F1, 0
RED = [1.0] + [0.0] * 7
BLUE = [0.0] * 7 + [1.0]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def card(id, batch, hashes, colors=RED, key=None):
    """Print row; one hash stands for rotation 0 alone."""
    hashes = [hashes] if isinstance(hashes, int) else hashes
    colors = [colors] * len(hashes) if not isinstance(colors[0], list) else colors
    prints = [(90 * i, signed(h), c) for i, (h, c) in enumerate(zip(hashes, colors))]
    return (id, batch, key or f"card-{id}", prints)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    rows = [(r.card_crop_id_a, r.card_crop_id_b) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_within_and_across_batches(spark):
    rows = table(spark, [card(1, 1, A), card(2, 1, CLOSE), card(3, 2, CLOSE), card(4, 2, FAR)])
    within = {(r.query_id, r.other_id) for r in duplicates.within_batch_hits(rows).collect()}
    across = {(r.query_id, r.other_id) for r in duplicates.cross_batch_hits(rows).collect()}
    assert within == {(2, 1)}
    assert across == {(3, 1), (3, 2)}


def test_unhashed_rows_find_nothing(spark):
    rows = table(spark, [(1, 1, "a", None), (2, 1, "b", [(0, None, RED)]), (3, 1, "c", [(0, 5, None)]), card(4, 1, 5)])
    assert found(find_duplicates(rows)) == set()


def test_colour_decides(spark):
    zero = [0.0] * 8
    rows = table(spark, [card(1, 1, A, RED), card(2, 1, A, BLUE), card(3, 1, A, zero), card(4, 1, A, zero), card(5, 2, A, RED)])
    assert found(find_duplicates(rows)) == {(1, 5)}


def test_bhattacharyya(spark):
    cases = [([1.0, 1.0], [1.0, 1.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 1.0), ([0.0, 0.0], [1.0, 0.0], None), (None, [1.0], None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<float>, b array<float>")
    for row in df.select("i", bhattacharyya(F.col("a"), F.col("b")).alias("d")).collect():
        expected = cases[row.i][2]
        assert row.d is None if expected is None else row.d == pytest.approx(expected, abs=1e-6)


def loop_match(query, other, config):
    best = None
    _, query_hash, query_color = query[3][0]
    for rotation, code, color in other[3]:
        distance = ((query_hash ^ code) & (1 << 64) - 1).bit_count()
        total = sum(query_color) * sum(color)
        if distance > config.structural_max or total == 0:
            continue
        overlap = sum(math.sqrt(a * b) for a, b in zip(query_color, color))
        apart = math.sqrt(max(0.0, 1 - overlap / math.sqrt(total)))
        if apart <= config.color_max and (best is None or distance < best[0]):
            best = (distance, rotation)
    return best


def random_cards(count, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)]
    colors = [RED, BLUE, [0.5] * 8, [0.0] * 8]

    def near(h):
        for bit in rng.sample(range(64), rng.randint(0, 7)):
            h ^= 1 << bit
        return h

    return [
        card(i, i % 3, [near(rng.choice(base)) for _ in range(4)], [rng.choice(colors) for _ in range(4)], key=f"k{i % 5}")
        for i in range(count)
    ]


@pytest.mark.parametrize("split_rows", [200_000, 10])
def test_search_equals_the_plain_loop(spark, split_rows):
    config = MatchConfig(structural_max=10, color_max=0.2, split_rows=split_rows)
    rows = random_cards(60, seed=4)
    rows += [(100 + i, i % 2, "copy", rows[0][3]) for i in range(20)]
    expected = {}
    for q in rows:
        for o in rows:
            best = loop_match(q, o, config) if q[0] > o[0] else None
            if best:
                expected[(o[0], q[0])] = (*best, q[2] == o[2])
    got = find_duplicates(table(spark, rows), config=config).collect()
    assert {
        (r.card_crop_id_a, r.card_crop_id_b): (r.structural_score, r.matched_rotation, r.filename_match) for r in got
    } == expected
    assert len(got) == len(expected)


def test_best_match_column_equals_the_plain_loop(spark):
    config = MatchConfig()
    rows = random_cards(40, seed=9)
    df = table(spark, rows)
    upright = duplicates.print_at(F.col("prints"), 0)
    q = df.select(F.col("id").alias("q"), upright["hash"].alias("h"), upright["color"].alias("c"), F.lit(1).alias("k"))
    pairs = q.join(df.withColumn("k", F.lit(1)), "k").select("q", "id", duplicates.best_match(F.col("h"), F.col("c"), F.col("prints"), config).alias("m"))
    for row in pairs.collect():
        best = loop_match(rows[row.q], rows[row.id], config)
        assert best == (None if row.m is None else (row.m.structural, row.m.rotation))


def test_either_direction_finds_a_turned_later_card(spark):
    rows = table(spark, [card(1, 1, [A, 0xFF << 40, 0xFF << 20, 0xFFFF]), card(2, 1, [0x0F0F0F0F0F0F0F0F, A, 0x3333 << 30, 0x5555 << 20])])
    assert found(find_duplicates(rows)) == set()
    assert found(find_duplicates(rows, direction="either")) == {(1, 2)}


def test_history_is_not_matched_against_itself(spark):
    history = table(spark, [card(10, 1, A), card(11, 1, CLOSE)])
    new = table(spark, [card(5, 2, A), card(12, 2, CLOSE)])
    assert found(find_duplicates(new, history)) == {(5, 10), (5, 11), (5, 12), (10, 12), (11, 12)}


def test_recorded_pairs_stay_away_in_any_state(spark):
    rows = table(spark, [card(1, 1, A), card(2, 1, A), card(3, 2, A)])
    known = spark.createDataFrame([(1, 2, "rejected"), (1, 3, "pending")], "card_crop_id_a long, card_crop_id_b long, status string")
    assert found(find_duplicates(rows, existing=known)) == {(2, 3)}


def test_folded_result_stays_small_for_copies(spark):
    rows = table(spark, [card(i, 1, A) for i in range(200)] + [card(500, 1, FAR)])
    folded = duplicates.fold_copies(rows)
    # The copies match themselves; a print with one row has no row to pair with.
    assert duplicates.match_prints(folded).count() == 1
    assert folded.members.count() == 201


@pytest.mark.parametrize("by", [None, ["batch_id"]])
def test_classes_hold_every_link_without_listing_it(spark, by):
    rows = random_cards(40, seed=6)
    rows += [(100 + i, i % 2, "copy", rows[0][3]) for i in range(30)] + [(200, 1, "none", []), (201, 1, "none", []), card(202, 1, A, [0.0] * 8)]
    config = MatchConfig()
    linked = {}
    for q in rows:
        for o in rows:
            if q[0] != o[0] and q[3] and loop_match(q, o, config) and (by is None or q[1] == o[1]):
                linked.setdefault(q[0], set()).add(o[0])
                linked.setdefault(o[0], set()).add(q[0])
    classes = duplicates.duplicate_classes(table(spark, rows), config, by)
    got = {r.id: r for r in classes.rows().collect()}
    assert set(got) == {r[0] for r in rows}
    assert {k: r.links for k, r in got.items()} == {r[0]: len(linked.get(r[0], ())) for r in rows}
    assert all(got[100 + i].class_id == (0 if by is None or i % 2 == rows[0][1] else 100 + i % 2) for i in range(30))
    pairs = [(r.id_a, r.id_b) for r in classes.expand(split_rows=7).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in linked for b in linked[a] if a < b}
    assert classes.pairs.count() < 200


@pytest.mark.parametrize("sent", [500_000, 0])
def test_colours_are_fetched_for_hits_alone_or_for_all(spark, monkeypatch, sent):
    monkeypatch.setattr(duplicates, "_SENT_PRINTS", sent)
    monkeypatch.setattr(duplicates, "_SENT_KEYS", sent)
    rows = random_cards(30, seed=8) + [(100 + i, 5, "copy", random_cards(30, seed=8)[3][3]) for i in range(4)]
    want = {(o[0], q[0]) for q in rows for o in rows if q[0] > o[0] and loop_match(q, o, MatchConfig())}
    assert found(find_duplicates(table(spark, rows))) == want
