import datetime as dt

from pyspark.sql import functions as F

from logprism.operators import store
from logprism.plans.backfill import backfill, run_backfill
from logprism.functions.keys import sample_hash

T0 = dt.datetime(2030, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def test_hash_is_over_content_only(spark):
    import hashlib

    rows = [("t", "f", "both", "x\ny", "stored", None, "h1"), ("t", "f", "both", "x\ny", "stored", None, "h2"),
            ("t", "f", "both", "x\ny", "error", "boom", "h1")]
    frame = spark.createDataFrame(
        rows, "target_id string, source_file string, sampling_mode string, sample_content string, "
        "processing_status string, error_details string, host string")
    got = [r[0] for r in frame.select(sample_hash()).collect()]
    want = hashlib.sha256("t\0f\0both\0x\ny\0stored\0".encode()).hexdigest()
    assert got[:2] == [want, want]
    assert got[2] == hashlib.sha256("t\0f\0both\0x\ny\0error\0boom".encode()).hexdigest()


def deliveries(spark):
    rows = [("a", minutes(5), "f", 1), ("a", minutes(3), "f", 2), ("b", minutes(1), "f", 3), ("c", minutes(1), "f", 4)]
    rows += [("hot", minutes(10 + i % 50), "f", 100 + i) for i in range(3000)]
    return spark.createDataFrame(rows, "sample_hash string, timestamp timestamp, source_file string, delivery_id long")


def test_dedup_and_outcomes(spark):
    incoming = deliveries(spark).repartition(8)
    known = spark.createDataFrame([("c",)], "sample_hash string")
    fresh = {(r.sample_hash, r.delivery_id) for r in store.dedup_samples(incoming, known).collect()}
    assert fresh == {("a", 2), ("b", 3), ("hot", 100)}
    outcomes = store.store_outcomes(incoming, known).collect()
    assert len(outcomes) == 3004
    assert {(r.sample_hash, r.delivery_id) for r in outcomes if r.outcome == "inserted"} == fresh


def test_equal_deliveries_have_one_winner(spark):
    rows = [("a", minutes(1), "f", 7)] * 5 + [("b", minutes(1), "f", 1), ("b", minutes(1), "f", 1)]
    incoming = spark.createDataFrame(rows, "sample_hash string, timestamp timestamp, source_file string, delivery_id long")
    known = spark.createDataFrame([], "sample_hash string")
    for frame in (incoming.repartition(4), incoming.drop("delivery_id")):
        outcomes = store.store_outcomes(frame, known).collect()
        assert len(outcomes) == 7
        assert sorted(r.sample_hash for r in outcomes if r.outcome == "inserted") == ["a", "b"]
        assert store.dedup_samples(frame, known).count() == 2


def test_unprocessed_are_ordered_and_counted(spark):
    rows = [(f"h{i}", minutes(i)) for i in range(20)] + [("h19", minutes(1)), ("h18", minutes(30))]
    samples = spark.createDataFrame(rows, "sample_hash string, timestamp timestamp").repartition(5)
    done = spark.createDataFrame([("h17",)], "sample_hash string")
    got = [r.sample_hash for r in store.unprocessed_samples(samples, done, 4).collect()]
    assert got == ["h18", "h19", "h16", "h15"]
    assert store.unprocessed_samples(samples, done).count() == 21


def test_dedup_cuts_before_the_shuffle(spark):
    plan = store.dedup_samples(deliveries(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):] and plan.count("WindowGroupLimit") == 2


def test_upsert(spark):
    schema = "sample_hash string, v string, analyzed_at timestamp"
    old = spark.createDataFrame([("a", "old", minutes(9)), ("b", "old", minutes(0))], schema)
    new = spark.createDataFrame([("a", "1", minutes(1)), ("a", "2", minutes(2)), ("c", "1", minutes(1))], schema)
    merged = {r.sample_hash: r.v for r in store.upsert(old, new, [F.desc("analyzed_at")]).collect()}
    assert merged == {"a": "2", "b": "old", "c": "1"}


def test_status_and_purge(spark):
    rows = [("a", "pending", "1"), ("b", "pending", "0"), ("c", "pending", None)]
    metadata = spark.createDataFrame(rows, "sample_hash string, classification_status string, preprocessing_version string")
    updates = spark.createDataFrame([("b", "failed"), ("zz", "failed")], "sample_hash string, new_status string")
    got = {r[0]: r[1] for r in store.update_status(metadata, updates).collect()}
    assert got == {"a": "pending", "b": "failed", "c": "pending"}
    kept, count = store.purge_stale(metadata, "1")
    assert [r.sample_hash for r in kept.collect()] == ["a"] and count.first().deleted == 2


def test_backfill_and_tables(spark, tmp_path):
    rows = [(f"h{i}", "t%d" % (i % 2), f"error {i}\nopenai call", minutes(i), "error" if i == 2 else "stored") for i in range(6)]
    samples = spark.createDataFrame(
        rows, "sample_hash string, target_id string, sample_content string, timestamp timestamp, processing_status string")
    done = spark.createDataFrame([("h0", "1"), ("h1", "0")], "sample_hash string, preprocessing_version string")
    assert {r.sample_hash for r in backfill(samples, done).collect()} == {"h2", "h3", "h4", "h5"}
    assert {r.sample_hash for r in backfill(samples, done, limit=2).collect()} == {"h4", "h5"}
    added = backfill(samples, done, reprocess_stale=True)
    assert {r.sample_hash for r in added.collect()} == {"h1", "h2", "h3", "h4", "h5"}
    dry = run_backfill(samples, done, str(tmp_path / "dry"), dry_run=True)
    assert (dry.attempted, dry.written, dry.failed) == (4, 0, 0) and not (tmp_path / "dry").exists()
    real = run_backfill(samples, done, str(tmp_path / "backfill"), limit=2)
    assert (real.attempted, real.written, real.failed, real.agentic) == (2, 2, 0, 0) and real.seconds > 0
    assert spark.read.parquet(str(tmp_path / "backfill")).count() == 2
    again = run_backfill(samples, done, str(tmp_path / "backfill"))
    assert (again.attempted, again.written, again.failed) == (4, 0, 4) and "exist" in again.error
    store.append_samples(samples, str(tmp_path / "samples"))
    store.append_samples(samples.withColumn("sample_hash", F.concat("sample_hash", F.lit("x"))), str(tmp_path / "samples"))
    table = spark.read.parquet(str(tmp_path / "samples"))
    assert table.where("target_id = 't1'").count() == 6
    assert "PartitionFilters: [isnotnull(target_id" in table.where("target_id = 't1'")._jdf.queryExecution().toString()
    store.write_table(added, str(tmp_path / "metadata"))
    assert spark.read.parquet(str(tmp_path / "metadata")).count() == 5
