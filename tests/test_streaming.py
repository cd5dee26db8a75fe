import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from imprint import AdmissionConfig, AlertConfig
from imprint.plans.duplicates import find_duplicates
from imprint.streaming import admission, growing, matching, stages
from tests.test_duplicates import found, random_cards, table

T0 = dt.datetime(2024, 1, 1)


def test_matching_a_stream_equals_one_search_and_survives_retries(spark, tmp_path):
    rows = random_cards(30, seed=12)
    expected = found(find_duplicates(table(spark, rows)))
    matcher = matching.IncrementalMatcher(str(tmp_path / "index"))
    matcher(table(spark, rows[:10]), 0)
    matcher(table(spark, rows[10:20]), 1)
    # The micro-batch fails after its writes and is delivered again.
    matcher(table(spark, rows[10:20]), 1)
    # Later rows arrive together with rows delivered before, and twice over.
    matcher(table(spark, rows[15:] + rows[25:]), 2)
    assert found(matcher.pairs(spark)) == expected


@pytest.mark.parametrize("epoch, failing", [(0, "ids"), (0, "pairs"), (1, "members"), (1, "prints"), (1, "hashes"), (2, "compact")])
def test_a_micro_batch_is_retried_after_a_crash_at_any_write(spark, tmp_path, monkeypatch, epoch, failing):
    rows = random_cards(12, seed=4)
    parts = [rows[:6], rows[6:] + rows[:2]] if epoch < 2 else [rows[:3], rows[3:6], rows[6:9], rows[9:]]
    matcher = matching.IncrementalMatcher(str(tmp_path / "index"), buckets=4, fan=2)
    write, save = matching.IncrementalMatcher._write, growing.GrowingTable._save

    def crash(self, frame, name, at):
        if name == failing and at == epoch:
            raise RuntimeError("lost")
        return write(self, frame, name, at)

    def crash_wide(self, frame, first, last):
        if last > first and "prints" in self.folder:
            frame.limit(0).write.mode("overwrite").parquet(f"{self.folder}/{self._name(first, last)}/bucket=0")  # half a part, without its mark
            raise RuntimeError("lost")
        return save(self, frame, first, last)

    for at, part in enumerate(parts):
        if at == epoch:
            if failing == "compact":
                monkeypatch.setattr(growing.GrowingTable, "_save", crash_wide)
            else:
                monkeypatch.setattr(matching.IncrementalMatcher, "_write", crash)
            with pytest.raises(RuntimeError):
                matcher(table(spark, part), at)
            monkeypatch.setattr(matching.IncrementalMatcher, "_write", write)
            monkeypatch.setattr(growing.GrowingTable, "_save", save)
        matcher(table(spark, part), at)
    assert found(matcher.pairs(spark)) == found(find_duplicates(table(spark, rows)))


def test_parts_of_a_size_become_one_and_old_ones_go(spark, tmp_path):
    grown = growing.GrowingTable(str(tmp_path / "t"), fan=3)
    frame = lambda k: spark.createDataFrame([(k, k % 2)], "v long, bucket int")
    for k in range(14):
        schema = grown.write(frame(k), k).schema
        grown.compact(spark, schema, k)
        assert sorted(r.v for r in grown.read(spark, schema).collect()) == list(range(k + 1))
        assert sorted(r.v for r in grown.read(spark, schema, k).collect()) == list(range(k))
        assert sorted(r.v for r in grown.read(spark, schema, buckets=[1]).collect()) == list(range(1, k + 1, 2))
        assert len(grown.parts(spark)) <= 2 * 3 + 1
    assert grown.parts(spark)[0] == (0, 8) and not (tmp_path / "t" / grown._name(0, 2)).exists()
    assert growing.GrowingTable(str(tmp_path / "none")).read(spark, schema).count() == 0


def test_a_micro_batch_opens_the_buckets_of_its_own_rows(spark, tmp_path):
    matcher = matching.IncrementalMatcher(str(tmp_path / "index"), buckets=32)
    matcher(table(spark, random_cards(60, seed=21)), 0)
    schema = matcher.table("prints").read(spark, spark.read.parquet(str(tmp_path / "index" / "prints")).drop("part").schema).schema
    some = matcher.table("prints").read(spark, schema, buckets=[3, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and {r.bucket for r in some.select("bucket").collect()} <= {3, 5}


def test_redelivery_within_the_watermark(spark, tmp_path):
    rows = random_cards(16, seed=3)
    source = str(tmp_path / "source")
    stamped = table(spark, rows + rows).withColumn("at", F.lit(T0))
    stamped.write.parquet(source)
    stream = spark.readStream.schema(stamped.schema).parquet(source)
    query = matching.start_matching(stream, str(tmp_path / "index"), str(tmp_path / "check"), event_time="at")
    assert query.awaitTermination(120)
    pairs = matching.IncrementalMatcher(str(tmp_path / "index")).pairs(spark)
    assert found(pairs) == found(find_duplicates(table(spark, rows)))


EVENTS = "id long, ts timestamp, batch_id long, stage string, status string, duration_ms long"


def test_running_metrics_equal_the_table(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 3, f"s{i % 2}", "failed" if i % 5 == 0 else "finished", i) for i in range(60)]
    df = spark.createDataFrame(rows, EVENTS)
    df.write.parquet(str(tmp_path / "source"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "source"))
    query = (
        stages.running_stage_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics")
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert set(spark.table("metrics").collect()) == set(stages.running_stage_metrics(df).collect())


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stuck_alert_fires_once_a_stage_lasts(spark, tmp_path, rocksdb):
    rows = [(1, T0, 1, "hashing", "started", None), (2, T0, 2, "rotation_review", "started", None)]
    df = spark.createDataFrame(rows, EVENTS)
    df.write.parquet(str(tmp_path / "source"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "source"))
    alerts = stages.stuck_alerts(stream, AlertConfig(stuck_seconds=2))
    query = alerts.writeStream.outputMode("update").format("memory").queryName("alerts").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("alerts").count() == 0:
            time.sleep(1)
        assert [(r.batch_id, r.stage) for r in spark.table("alerts").collect()] == [(1, "hashing")]
    finally:
        query.stop()


def run_parts(spark, tmp_path, parts, schema, operator):
    """Rows that an operator emits over parts that arrive one after the other; the folder of its checkpoint."""
    source, out = str(tmp_path / "source"), []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            operator(stream).writeStream.foreachBatch(lambda frame, _: out.extend(tuple(r) for r in frame.collect()))
            .outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(300)
    return out, str(tmp_path / "check")


def test_admission_holds_no_state_of_idle_keys_and_drops_late_attempts(spark, tmp_path, rocksdb):
    config = AdmissionConfig(max_attempts=2, window_seconds=60)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [
        [("a", 1, at(0)), ("a", 2, at(10)), ("a", 3, at(20)), ("b", 4, at(30))],
        [("a", 5, at(61)), ("c", 6, at(3600))],
        [("a", 7, at(5)), ("c", 8, at(3601)), ("c", 9, at(3602))],
        [("c", 10, at(3650))],
    ]
    got, check = run_parts(spark, tmp_path, parts, "key string, id long, ts timestamp", lambda s: admission.admit_stream(s, config, "1 minute"))
    assert {(k, i): a for k, i, a in got} == {
        ("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 4): True, ("a", 5): True, ("c", 6): True, ("c", 8): True, ("c", 9): False, ("c", 10): False,
    }
    state = spark.read.format("statestore").option("stateVarName", "admitted").load(check)
    assert {r.key["key"] for r in state.select("key").collect()} == {"c"}


def test_gaps_alert_by_the_times_of_events(spark, tmp_path, rocksdb):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [
        [(1, at(0), 1, "hashing"), (2, at(30), 1, "cropping"), (3, at(0), 2, "rotation_review"), (4, at(50), 3, "hashing"), (5, at(200), 3, "cropping")],
        [(6, at(210), 1, "hashing"), (7, at(220), 4, "extracting")],
        [(8, at(5000), 5, "complete")],
    ]
    schema = "id long, ts timestamp, batch_id long, stage string"
    got, _ = run_parts(spark, tmp_path, parts, schema, lambda s: stages.stuck_gaps(s, AlertConfig(stuck_seconds=100), "10 seconds"))
    assert sorted((b, s, (t - T0).total_seconds()) for b, s, t in got) == [
        (1, "cropping", 30.0), (1, "hashing", 210.0), (3, "cropping", 200.0), (3, "hashing", 50.0), (4, "extracting", 220.0),
    ]


def test_gaps_of_events_out_of_order_and_at_the_bounds_without_python(spark, tmp_path, rocksdb):
    at = lambda s, us=0: T0 + dt.timedelta(seconds=s, microseconds=us)
    parts = [
        [(1, at(0), 1, "hashing"), (3, at(150), 1, "cropping"), (4, at(0), 2, "hashing"), (5, at(100), 2, "complete"), (6, at(0), 3, "hashing"), (7, at(100, 1), 3, "complete")],
        # Comes later than an event after it, but in time.
        [(2, at(60), 1, "hashing"), (8, at(900, 1), None, "hashing")],
        # The watermark is 1000 s: a timer of one millisecond past the limit has come for batch 4, not for 5.
        [(9, at(899, 999_000), 4, "hashing"), (10, at(899, 999_001), 5, "hashing"), (11, at(1100), 6, "complete")],
    ]
    schema = "id long, ts timestamp, batch_id long, stage string"
    plans = []

    def operator(stream):
        gaps = stages.stuck_gaps(stream, AlertConfig(stuck_seconds=100), "100 seconds")
        plans.append(gaps._jdf.queryExecution().logical().toString())
        return gaps

    got, _ = run_parts(spark, tmp_path, parts, schema, operator)
    assert sorted((b, s, t) for b, s, t in got) == [(1, "cropping", at(150)), (3, "hashing", at(0)), (4, "hashing", at(899, 999_000))]
    assert not any("Python" in p or "Pandas" in p for p in plans)
