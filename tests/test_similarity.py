import random

import pytest
from pyspark.sql import functions as F

from imprint.functions import bits
from imprint.operators import similarity
from imprint.operators.bands import BandPlan
from imprint.operators.similarity import hamming_join, similarity_join


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def table(spark, rows):
    return spark.createDataFrame([(i, signed(h)) for i, h in rows], "id long, hash long")


def pairs(df):
    rows = [(r.left_id, r.right_id, r.distance) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(left, right, radius):
    return {
        (a, b, (x ^ y).bit_count()) for a, x in left for b, y in right if (x ^ y).bit_count() <= radius
    }


def planted(count, seed, most=13):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        h = rng.getrandbits(64)
        near = h
        for bit in rng.sample(range(64), rng.randint(0, most)):
            near ^= 1 << bit
        rows += [(2 * i, h), (2 * i + 1, near)]
    return rows


def test_known_values(spark):
    rows = [(1, 0xF0F0F0F0F0F0F0F0), (2, 0xF0F0F0F0F0F0F0F1), (3, 0)]
    got = pairs(hamming_join(table(spark, rows), table(spark, rows[:1]), 2))
    assert got == {(1, 1, 0), (2, 1, 1)}
    ends = [(1, 0xFFFFFFFFFFFFFFFF), (2, 0)]
    assert pairs(hamming_join(table(spark, ends), table(spark, ends[:1]), 0)) == {(1, 1, 0)}
    same = [(1, 0xAAAAAAAAAAAAAAAA), (2, 0xAAAAAAAAAAAAAAAA)]
    assert pairs(hamming_join(table(spark, same), table(spark, same[:1]), 0)) == {(1, 1, 0), (2, 1, 0)}


@pytest.mark.parametrize("radius, bands", [(10, 4), (10, 3), (10, 8), (3, 2), (0, 1), (20, 9)])
def test_every_plan_equals_brute_force(spark, radius, bands):
    rows = planted(200, seed=radius * 100 + bands, most=radius + 3)
    df = table(spark, rows)
    got = pairs(hamming_join(df, df, radius, plan=BandPlan.balanced(radius, bands)))
    assert got == brute(rows, rows, radius)


def test_plans_are_complete_by_construction():
    for radius in range(0, 33):
        plan = BandPlan.for_sizes(radius, 10_000, 40_000)
        assert sum(plan.limits) >= radius - len(plan.widths) + 1
    with pytest.raises(ValueError):
        BandPlan(10, (16, 16, 16, 16), (1, 1, 1, 1))


def test_larger_tables_get_wider_bands():
    small, large = BandPlan.for_sizes(10, 10**4, 10**4), BandPlan.for_sizes(10, 10**9, 10**9)
    assert len(large.widths) < len(small.widths)
    assert large.pair_share < small.pair_share


def test_hot_hash_and_hot_band_are_split_and_whole(spark):
    """A third of all rows are copies, a third share three of four bands."""
    rng = random.Random(3)
    rows = [(i, 0) for i in range(150)]
    rows += [(1000 + i, rng.getrandbits(16)) for i in range(150)]
    rows += [(2000 + i, rng.getrandbits(64)) for i in range(150)]
    df = table(spark, rows)
    expected = brute(rows, rows, 6)
    assert pairs(hamming_join(df, df, 6, split_rows=20)) == expected
    assert pairs(hamming_join(df, df, 6)) == expected


def test_few_probes_against_a_large_index(spark, monkeypatch):
    """The probes are broadcast; the index is neither shuffled nor folded."""
    monkeypatch.setattr(similarity, "_BROADCAST_ROWS", 1000)
    rows = planted(300, seed=21)
    few = rows[:6]
    joined = similarity.hamming_join(table(spark, few), table(spark, rows + [(900 + i, rows[0][1]) for i in range(5)]), 10)
    assert pairs(joined) == brute(few, rows + [(900 + i, rows[0][1]) for i in range(5)], 10)


def test_equality_columns(spark):
    rows = [(i, i % 3, signed(h)) for i, h in planted(60, seed=8)]
    df = spark.createDataFrame(rows, "id long, grp long, hash long")
    got = {(r.left_id, r.right_id) for r in hamming_join(df, df, 10, by=["grp"]).collect()}
    mask = (1 << 64) - 1
    assert got == {
        (a, b) for a, g, x in rows for b, k, y in rows if g == k and ((x ^ y) & mask).bit_count() <= 10
    }


def test_other_metric(spark):
    df = spark.createDataFrame([(1, "card"), (2, "cart"), (3, "zebra")], "id long, value string")
    cross = lambda a, b: a.select(F.col("id").alias("left_id"), F.lit(1).alias("k")).join(
        b.select(F.col("id").alias("right_id"), F.lit(1).alias("k")), "k"
    ).drop("k")
    got = similarity_join(df, df, F.levenshtein, 1, cross).filter("left_id < right_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]


@pytest.mark.parametrize("radius, split_rows, bands", [(10, 200_000, None), (10, 3, None), (20, 200_000, 6), (3, 200_000, 2), (0, 200_000, 1)])
def test_self_join_finds_each_pair_once(spark, radius, split_rows, bands):
    rows = planted(120, seed=radius) + [(1000 + i, planted(120, seed=radius)[0][1]) for i in range(9)]
    df = table(spark, rows)
    plan = BandPlan.balanced(radius, bands) if bands else None
    got = [(r.left_id, r.right_id, r.distance) for r in similarity.hamming_self_join(df, radius, plan=plan, split_rows=split_rows).collect()]
    mask = (1 << 64) - 1
    want = {(a, b, ((x ^ y) & mask).bit_count()) for a, x in rows for b, y in rows if a < b and ((x ^ y) & mask).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_self_join_tests_half_the_pairs(spark):
    hashes = table(spark, planted(200, seed=2)).select("hash").distinct()
    plan = BandPlan.balanced(10, 4)
    both, half = (similarity._probe_rows(hashes, plan, [], symmetric=s).count() for s in (False, True))
    assert half < 0.55 * both


def _metric_pairs(df, distance, radius, **settings):
    return [(r.left_id, r.right_id) for r in similarity.metric_self_join(df, distance, radius, **settings).collect()]


@pytest.mark.parametrize("cell, pivots, split_rows", [(256, 32, 200_000), (8, 4, 200_000), (5, 3, 6)])
def test_any_metric_without_a_key(spark, cell, pivots, split_rows):
    rng = random.Random(cell)
    points = [(i, [rng.uniform(0, 30), rng.uniform(0, 30)]) for i in range(400)]
    points += [(400 + i, points[0][1]) for i in range(12)] + [(900, None)]
    df = spark.createDataFrame(points, "id long, value array<double>").repartition(3)
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
    got = _metric_pairs(df, l1, 1.5, cell=cell, pivots=pivots, split_rows=split_rows)
    want = {(i, j) for i, a in points for j, b in points if i < j and a and b and abs(a[0] - b[0]) + abs(a[1] - b[1]) <= 1.5}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_edit_distance_and_hamming_as_metrics(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(150)] + [""]
    df = spark.createDataFrame(list(enumerate(words)), "id long, value string")
    edits = df.alias("a").join(df.alias("b"), F.expr("a.id < b.id AND levenshtein(a.value, b.value) <= 1")).select("a.id", "b.id").collect()
    assert sorted(_metric_pairs(df, F.levenshtein, 1, cell=10, pivots=5)) == sorted(map(tuple, edits))
    rows = planted(150, seed=5)
    want = [(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 6]
    got = _metric_pairs(table(spark, rows).withColumnRenamed("hash", "value"), similarity.hamming_distance, 6, cell=20, pivots=8)
    assert sorted(got) == sorted(want)


def test_pivots_leave_few_candidates(spark):
    rng = random.Random(7)
    points = [(i, [rng.uniform(0, 100), rng.uniform(0, 100)]) for i in range(3000)]
    df = spark.createDataFrame(points, "id long, value array<double>")
    l1 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
    tested = []
    plain = similarity.candidate_pairs

    def counted(*args):
        out = plain(*args)
        tested.append(out.count())
        return out

    similarity.candidate_pairs = counted
    try:
        similarity.metric_self_join(df, l1, 1.0).count()
    finally:
        similarity.candidate_pairs = plain
    assert tested[0] < 0.01 * 3000 * 2999 / 2


def test_hex_round_trip_and_median_bits(spark):
    hexes = ["ffffffffffffffff", "0000000000000001", "8000000000000000", "f0f0f0f0f0f0f0f0"]
    df = spark.createDataFrame([(h,) for h in hexes], "h string")
    assert [r[0] for r in df.select(bits.hash_to_hex(bits.hash_from_hex(F.col("h")))).collect()] == hexes
    rng = random.Random(2)
    values = [rng.random() for _ in range(64)]
    ranked = sorted(values)
    median = (ranked[31] + ranked[32]) / 2
    turned = [values[(7 - i % 8) * 8 + i // 8] for i in range(64)]
    row = spark.createDataFrame([(values,)], "v array<double>").select(
        bits.hash_to_hex(bits.median_bits(F.col("v"))).alias("a"),
        bits.hash_to_hex(bits.median_bits(bits.turn_grid(F.col("v"), 1))).alias("b"),
    ).first()
    code = lambda vs: f"{int(''.join('1' if v > median else '0' for v in vs), 2):016x}"
    assert (row.a, row.b) == (code(values), code(turned))


def test_candidates_that_bring_their_values_are_not_joined_again(spark):
    rows = spark.createDataFrame([(1, "k", "abcd"), (2, "k", "abce"), (3, "k", "zzzz"), (4, "m", "abcd")], "id long, kind string, value string")

    def same_kind(left, right):
        sides = [d.select(F.col("id").alias(f"{s}_id"), F.col("value").alias(f"{s}_value"), "kind") for s, d in (("left", left), ("right", right))]
        return sides[0].join(sides[1], "kind").filter("left_id < right_id")

    joined = similarity_join(rows, rows, F.levenshtein, 3, same_kind)
    assert [tuple(r) for r in joined.collect()] == [(1, 2, 1)]
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_pairs_of_values_are_dealt_by_the_pairs_of_rows_they_make(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_TASK_PAIRS", 100)
    monkeypatch.setattr(similarity, "_GROUP", 7)
    rows = spark.createDataFrame([(i, float(i % 2)) for i in range(60)] + [(None, 0.0)], "id long, value double").coalesce(1)
    pairs = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 0.0, 0.0)], "left_value double, right_value double, distance double")
    found = similarity._members(pairs, rows)
    made = [[(r.left_id, r.right_id) for r in part] for part in found.select("left_id", "right_id").rdd.glom().collect()]
    assert len(made) >= 18 and max(map(len, made)) < 900
    even, odd = range(0, 60, 2), range(1, 60, 2)
    want = [(a, b) for a in even for b in odd] + [(None, b) for b in odd] + [(a, b) for a in even for b in even if a < b]
    assert sorted(map(str, sum(made, []))) == sorted(map(str, want))
