import datetime as dt

import pytest
from pyspark.sql import functions as F

from imprint.functions import numeric
from imprint.operators import catalog, quality, retention, review, status
from imprint.plans.cards import card_detail

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    batches = spark.createDataFrame([(i, f"lot {i}", "cropping") for i in range(1, 7)], "id long, source_label string, status string")
    scans = spark.createDataFrame(
        [
            (1, 2, "raw/2/1", "c1-front.jpg", "c1", "front", "pending"),
            (2, 3, "raw/3/2", "c1-front.jpg", "c1", "front", "cropped"),
            (3, 3, "raw/3/3", "c1-back.jpg", "c1", "back", "cropped"),
            (4, 4, "raw/4/4", "c1-front.jpg", "c1", "front", "cropped"),
            (5, 4, "raw/4/5", "c2-front.jpg", "c2", "front", "cropped"),
            (6, 5, "raw/5/6", "c2-front.jpg", "c2", "front", "crop_failed"),
            (7, 6, "raw/6/7", "c9-front.jpg", "c9", "front", "cropped"),
        ],
        "id long, batch_id long, r2_key_raw string, original_filename string, pairing_key string, side string, status string",
    )
    crops = spark.createDataFrame(
        [
            (12, 2, "k12", 0, None), (13, 3, "k13", 90, T0), (14, 4, "k14", None, T0), (15, 5, "k15", 270, T0),
            (16, 6, None, 0, None), (17, 7, "k17", 0, T0),
        ],
        "id long, raw_scan_id long, r2_key_cropped string, rotation_degrees int, rotation_confirmed_at timestamp",
    )
    candidates = spark.createDataFrame(
        [
            (1, 14, 15, 3.0, 0.1, True, "pending", None, None), (2, 14, 17, 1.0, float("nan"), False, "confirmed_duplicate", 1, T0),
            (3, 13, 14, 2.0, 0.2, False, "rejected", 1, T0),
        ],
        "id long, card_crop_id_a long, card_crop_id_b long, structural_score double, color_score double, filename_match boolean, status string, reviewed_by long, reviewed_at timestamp",
    )
    return batches, scans, crops, candidates


def test_status_and_counts(tables):
    got = {r.batch_id: (r.status, r.progress) for r in status.batch_status(*tables).collect()}
    assert got == {
        1: ("extracting", 20), 2: ("cropping", 20), 3: ("rotation_review", 70), 4: ("duplicate_review", 80),
        5: ("complete", 100), 6: ("complete", 100),
    }
    counts = {r.batch_id: r for r in status.batch_counts(*tables).collect()}
    assert (counts[1].scans, counts[3].pending_rotation, counts[4].pending_duplicate_review) == (0, 1, 1)


def test_siblings(tables):
    _, scans, crops, _ = tables
    got = {r.id: r.sibling_id for r in review.siblings(status.crops_with_scans(crops, scans)).collect()}
    # Both ways within a batch; never across batches, never on the same side.
    assert got == {12: 13, 13: 12, 14: None, 15: None, 16: None, 17: None}


def test_queues(tables):
    _, scans, crops, candidates = tables
    queue = status.rotation_queue(crops, scans)
    assert [r.id for r in review.next_in_rotation(queue).collect()] == [12]
    assert review.next_in_rotation(queue, after_id=12).count() == 0
    assert review.next_in_rotation(queue, batch_id=4).count() == 0
    assert [r.id for r in review.next_pending_pair(candidates).collect()] == [1]
    depths = {r.queue: r.depth for r in status.queue_depths(crops, scans, candidates).collect()}
    assert depths == {"rotation": 1, "duplicates": 1}


def test_last_valid_decision_holds(spark, tables):
    decisions = spark.createDataFrame(
        [(1, 1, "rejected", 7, T0), (1, 2, "confirmed_duplicate", 8, T0), (1, 3, "pending", 9, T0), (2, 1, None, 9, T0)],
        "candidate_id long, seq long, status string, reviewed_by long, reviewed_at timestamp",
    )
    got = {r.id: (r.status, r.reviewed_by) for r in review.apply_decisions(tables[3], decisions).collect()}
    assert got == {1: ("confirmed_duplicate", 8), 2: ("confirmed_duplicate", 1), 3: ("rejected", 1)}
    assert review.split_decisions(decisions)[1].count() == 2


def test_rotations_and_confirmations(spark, tables):
    crops = tables[2]
    requests = spark.createDataFrame([(13, 90), (13, -90), (13, 45), (14, -90), (15, 180), (15, 360)], "crop_id long, degrees int")
    got = {r.id: r.rotation_degrees for r in review.apply_rotations(crops, requests).collect()}
    assert (got[13], got[14], got[15], got[12]) == (90, 270, 90, 0)
    later = dt.datetime(2024, 5, 1)
    stamped = review.apply_confirmations(crops, spark.createDataFrame([(12, later)], "crop_id long, confirmed_at timestamp"))
    assert {r.id: r.rotation_confirmed_at for r in stamped.collect()}[12] == later


@pytest.mark.parametrize("degrees, expected", [(90, 90), (180, 180), (270, 270), (-90, 270), (45, None), (360, None)])
def test_quarter_turns(spark, degrees, expected):
    assert spark.range(1).select(numeric.quarter_turn(F.lit(degrees))).first()[0] == expected


@pytest.mark.parametrize("value, expected", [(0.25, 0.25), (None, None), (float("nan"), None), (float("-inf"), None)])
def test_finite(spark, value, expected):
    assert spark.range(1).select(numeric.finite_or_null(F.lit(value).cast("double"))).first()[0] == expected


def test_force_advance(spark, tables):
    requested = spark.createDataFrame([(2,), (5,)], "batch_id long")
    moved, rejected = review.force_advance(*tables, requested)
    assert {r.id: r.status for r in moved.collect()}[1] == "crop_failed"
    assert [(r.batch_id, r.batch_status) for r in rejected.collect()] == [(5, "complete")]


def test_losers_belong_to_the_keeper(tables):
    _, scans, crops, candidates = tables
    listed = {r.id: r for r in catalog.scan_listing(scans, crops, candidates, "http://x/").collect()}
    # 17 lost against 14 of batch 4, so it stays in its own batch 6.
    assert not listed[7].is_duplicate and listed[1].thumbnail_url is None and listed[4].rotation_degrees == 0
    everywhere = {r.id: r.is_duplicate for r in catalog.scan_listing(scans, crops, candidates, "http://x", scope="any").collect()}
    assert everywhere[7] and not everywhere[4]
    pair = catalog.confirmed_pairs(candidates, crops, scans, "http://x").first()
    assert (pair.kept_url, pair.removed_url, pair.color_score, pair.batch_id) == ("http://x/k14", "http://x/k17", None, 4)


def test_history_covers_both_sides(spark, tables):
    wanted = spark.createDataFrame([(14,), (17,)], "id long")
    got = {(r.crop_id, r.candidate_id) for r in catalog.pair_history(wanted, tables[3]).collect()}
    assert got == {(14, 1), (14, 2), (14, 3), (17, 2)}


def test_page_bounds(tables):
    with pytest.raises(ValueError):
        catalog.card_page(tables[2], 201)


def test_cascade(spark, tables):
    doomed = tables[0].filter("id = 4")
    left = retention.cascade_delete(doomed, *tables)
    assert sorted(r.id for r in left.crops.collect()) == [12, 13, 16, 17]
    assert left.candidates.count() == 0 and left.batches.count() == 5 and left.scans.count() == 5
    keys = {r.key for r in retention.storage_keys(doomed, tables[1], tables[2]).collect()}
    assert keys == {"tmp/uploads/4.zip", "raw/4/4", "raw/4/5", "k14", "k15"}


def test_many_failure_notes_stay_whole(spark):
    removals = spark.range(2500).selectExpr("1L AS batch_id", "concat('k', id) AS key", "'timeout' AS error").unionByName(
        spark.createDataFrame([(2, "a", "x"), (2, "b", None), (2, "c", "y"), (3, "d", None)], "batch_id long, key string, error string")
    )
    got = {r.batch_id: (r.keys_deleted, r.keys_failed, r.note_parts) for r in retention.deletion_accounting(removals).collect()}
    assert got == {1: (0, 2500, 3), 2: (1, 2, 1), 3: (1, 0, 0)}
    assert {r.batch_id: r.notes for r in retention.failure_notes(removals).collect() if r.batch_id == 2} == {2: "a: x; c: y"}
    assert retention.failure_notes(removals).filter("batch_id = 1").count() == 3
    notes = [n for r in retention.failure_notes(removals).filter("batch_id = 1").collect() for n in r.notes.split("; ")]
    assert sorted(notes) == sorted(f"k{i}: timeout" for i in range(2500))


def test_audit_finds_each_fault(spark, tables):
    batches, scans, crops, candidates = tables
    users = spark.createDataFrame([(1, "a"), (2, "a")], "id long, name string")
    assert {r.rule for r in quality.constraint_audit(batches, scans, crops, candidates, users).collect()} == {"user_name_unique"}
    faulty = crops.withColumn("raw_scan_id", F.when(F.col("id") == 13, 2).otherwise(F.col("raw_scan_id")))
    found = {(r.rule, r.key) for r in quality.constraint_audit(batches.filter("id <> 6"), scans, faulty, candidates, users).collect()}
    assert found == {("user_name_unique", "a"), ("crop_scan_unique", "2"), ("scan_without_batch", "7")}


def test_audit_reads_each_table_once_for_each_use(spark, tables):
    batches, scans, crops, candidates = tables
    users = spark.createDataFrame([(1, "a")], "id long, name string")
    plan = quality.constraint_audit(batches, scans, crops, candidates, users)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_the_last_of_decisions_with_one_number_is_defined(spark, tables):
    candidates = spark.createDataFrame([(1, "pending", None, None)], "id long, status string, reviewed_by long, reviewed_at timestamp")
    rows = [(1, 5, "rejected", 3, None), (1, 5, "confirmed_duplicate", 9, None), (1, 5, "rejected", 2, None)]
    for order in (rows, rows[::-1]):
        decisions = spark.createDataFrame(order, "candidate_id long, seq long, status string, reviewed_by long, reviewed_at timestamp")
        done = review.apply_decisions(candidates, decisions.repartition(3)).first()
        assert (done.status, done.reviewed_by) == ("rejected", 3)


def test_deletion_accounting_has_the_whole_notes(spark):
    removals = spark.createDataFrame(
        [(1, f"k{i}", "timeout") for i in range(1200)] + [(2, "a", "x"), (2, "a b", "z"), (2, "c", None), (3, "d", None)],
        "batch_id long, key string, error string",
    )
    got = {r.batch_id: (r.notes, r.note_parts) for r in retention.deletion_accounting(removals).collect()}
    whole = "; ".join(f"{k}: timeout" for k in sorted(f"k{i}" for i in range(1200)))
    assert got == {1: (whole, 2), 2: ("a: x; a b: z", 1), 3: (None, 0)}


def test_history_of_all_crops_joins_each_pair_once(spark):
    crops = spark.createDataFrame(
        [(1, 10, "k1"), (3, 11, "k3"), (5, 12, None), (5, 12, "k5"), (7, 13, "k7"), (9, 99, "k9")], "id long, raw_scan_id long, r2_key_cropped string"
    )
    scans = spark.createDataFrame(
        [(10, 1, "a-front.jpg", "a", "front"), (11, 1, "a-back.jpg", "a", "back"), (12, 2, "b.jpg", "b", None), (13, 2, "b-front.jpg", "b", "front")],
        "id long, batch_id long, original_filename string, pairing_key string, side string",
    )
    pairs = spark.createDataFrame(
        [(100, 1, 3), (101, 3, 5), (102, 7, 7), (103, None, 5), (104, 20, 21), (105, 1, 20), (106, 9, 7)],
        "id long, card_crop_id_a long, card_crop_id_b long",
    ).selectExpr("*", "double('NaN') AS structural_score", "0.5D AS color_score")
    detail, whole = card_detail(crops, crops, scans, pairs, "https://x/")
    _, chosen = card_detail(crops.select("*"), crops, scans, pairs, "https://x/")
    assert sorted(whole.columns) == sorted(chosen.columns)
    rows = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    assert rows(whole) == rows(chosen) and len(rows(whole)) == 16
    first = whole.filter("crop_id = 1 AND candidate_id = 100").first()
    assert (first.a_image_url, first.a_front_image_url, first.a_back_image_url) == ("https://x/k1", "https://x/k1", "https://x/k3")
    assert first.structural_score is None and {"image_url", "front_image_url", "back_image_url"} <= set(detail.columns)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
