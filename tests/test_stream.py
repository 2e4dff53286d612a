"""Streams give what one batch gives, also over restarts and repeats."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logprism.plans.profile import profile
from logprism.schemas import SAMPLE
from logprism.streaming.ingest import SampleStore, drop_repeats, ingest, read_deliveries, read_log_files
from logprism.streaming.versions import Conflict


def delivery(spark, keys, minute):
    rows = [(k, dt.datetime(2030, 1, 1) + dt.timedelta(minutes=minute), f"openai {k}\nerror: x") for k in keys]
    frame = spark.createDataFrame(rows, "sample_hash string, timestamp timestamp, sample_content string")
    filled = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in SAMPLE.split(", ")}
    for name in frame.columns:
        filled[name] = F.col(name)
    filled["target_id"] = F.lit("t")
    return frame.select(*[column.alias(name) for name, column in filled.items()])


@pytest.fixture
def feed(spark, tmp_path):
    class Feed:
        path = str(tmp_path / "in")
        store = SampleStore(spark, str(tmp_path / "store"), 1)

        def send(self, keys, minute):
            delivery(spark, keys, minute).coalesce(1).write.mode("append").parquet(self.path)

        def run(self, stream="s", files=1, **options):
            deliveries = read_deliveries(spark, self.path, files_per_cycle=files)
            ingest(deliveries, self.store, str(tmp_path / f"progress-{stream}"), stream=stream, once=True, **options).awaitTermination()

        def keys(self, table="samples"):
            return sorted(r.sample_hash for r in self.store.read(table).collect())

    return Feed()


def test_once_each_and_profiled(spark, feed):
    feed.send(["a", "b", "b"], 1)
    feed.send(["b", "c"], 2)
    feed.run()
    feed.send(["a", "c", "d"], 90)
    feed.run()
    rows = {r.sample_hash: r for r in feed.store.read("samples").collect()}
    assert sorted(rows) == ["a", "b", "c", "d"] and feed.store.read("samples").count() == 4
    assert rows["b"].timestamp == dt.datetime(2030, 1, 1, 0, 1)
    columns = ["sample_hash", "format", "agentic_scan", "ingestion_hints"]
    streamed = {r.sample_hash: r for r in feed.store.read("metadata").select(*columns).collect()}
    batch = {r.sample_hash: r for r in profile(feed.store.read("samples")).select(*columns).collect()}
    assert streamed == batch


@pytest.mark.parametrize("files", [1, 1000])
def test_decisions_do_not_depend_on_the_batches(feed, files):
    for keys, minute in ((["d", "e"], 602), (["a", "b", "c"], 601), (["a", "f"], 1), (["g"], 600)):
        feed.send(keys, minute)
    feed.run(files=files)
    assert feed.keys() == list("abcdefg")
    got = feed.store.decisions(max_per_cycle=2, cycle=F.date_trunc("hour", "timestamp")).collect()
    assert {r.sample_hash: r.decision for r in got} == {
        "a": "classify", "f": "classify", "g": "classify", "b": "classify", "c": "capped", "d": "capped", "e": "capped"}


def test_repeated_batch_changes_nothing(spark, feed):
    first, second = delivery(spark, ["a", "b"], 1), delivery(spark, ["b", "c"], 2)
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        feed.store.add_batch(rows, "s", batch)
    for table in ("samples", "metadata", "keys"):
        assert feed.keys(table) == ["a", "b", "c"], table


def test_a_batch_without_rows_counts_and_adds_no_parts(spark, feed):
    feed.store.add_batch(delivery(spark, ["a"], 1), "s", 0)
    before = feed.store.versions.latest()[1]["tables"]
    for _ in range(2):
        assert feed.store.add_batch(delivery(spark, ["b"], 1).limit(0), "s", 1).count() == 0
    assert feed.store.last_batch("s") == 1 and feed.store.versions.latest()[1]["tables"] == before
    feed.store.add_batch(delivery(spark, ["a", "b"], 2), "s", 2)
    assert feed.keys() == ["a", "b"]


def test_a_new_stream_keeps_what_others_stored(feed):
    feed.send(["a"], 1)
    feed.run("one")
    feed.send(["b"], 2)
    feed.run("two")
    assert feed.keys() == ["a", "b"]
    feed.store.compact()
    feed.send(["b", "c"], 3)
    feed.run("three")
    assert feed.keys() == ["a", "b", "c"]


def files(store, table):
    """The parts of a table on storage that hold files."""
    return {f.relative_to(Path(store.path, table)).parts[0] for f in Path(store.path, table).rglob("*.parquet")}


def test_a_batch_run_again_after_compaction_keeps_its_samples(spark, feed):
    first = delivery(spark, ["a", "b"], 1)
    feed.store.add_batch(first, "s", 0)
    feed.store.add_batch(delivery(spark, ["b", "c"], 2), "s", 1)
    before = files(feed.store, "keys")
    feed.store.compact()
    assert len(before) == 2 and len(files(feed.store, "keys")) == 1 and not files(feed.store, "keys") & before
    again = feed.store.add_batch(delivery(spark, ["b", "c"], 2), "s", 1)
    assert [r.sample_hash for r in again.collect()] == ["c"]
    feed.store.add_batch(first, "s", 0)
    feed.store.add_batch(delivery(spark, ["c", "d"], 3), "other", 0)
    for table in ("samples", "metadata", "keys", "sightings"):
        assert sorted(set(feed.keys(table))) == ["a", "b", "c", "d"], table
    assert feed.keys("samples") == feed.keys("metadata") == feed.keys("keys") == ["a", "b", "c", "d"]


def test_compaction_shrinks_the_tables(spark, feed):
    for batch in range(4):
        feed.store.add_batch(delivery(spark, ["a", f"k{batch}"], batch), "s", batch)
    before = {table: len(files(feed.store, table)) for table in ("keys", "metadata", "sightings")}
    feed.store.compact()
    after = {table: len(files(feed.store, table)) for table in before}
    assert set(before.values()) == {4} and set(after.values()) == {1}
    assert feed.keys("sightings") == feed.keys("keys") == ["a", "k0", "k1", "k2", "k3"]


def test_a_batch_reads_the_folders_of_its_keys_only(spark, feed):
    feed.store.add_batch(delivery(spark, [f"k{i}" for i in range(60)], 1), "s", 0)
    _, state = feed.store.versions.latest()
    every, some = feed.store._paths(state, "keys", [f"{i:x}" for i in range(16)]), feed.store._paths(state, "keys", ["0", "7"])
    assert len(every) == 16 and [p.rpartition("=")[2] for p in some] == ["0", "7"]
    plan = feed.store._rows("keys", some)
    assert 0 < plan.count() < 60 and set(plan.inputFiles()) < set(feed.store._rows("keys", every).inputFiles())


def statuses(store):
    return {r.sample_hash: r.classification_status for r in store.read("metadata").collect()}


def test_outcomes_change_the_store(spark, feed):
    feed.store.add_batch(delivery(spark, list("abcdefgh"), 1), "s", 0)
    updates = spark.createDataFrame([("a", "failed"), ("a", "classified"), ("c", "failed"), ("zz", "failed"), (None, "failed")], "sample_hash string, new_status string")
    feed.store.update_status(updates)
    want = {k: "pending" for k in "abcdefgh"} | {"a": "classified", "c": "failed"}
    assert statuses(feed.store) == want
    feed.store.compact()
    assert statuses(feed.store) == want and len(feed.store.versions.latest()[1]["tables"]["metadata"]) == 1
    stale = feed.store.read("metadata").where("sample_hash in ('b', 'c')").withColumn("preprocessing_version", F.lit(None).cast("string"))
    feed.store.merge_metadata(stale.unionByName(stale), [F.col("analyzed_at")])
    assert sorted(statuses(feed.store)) == list("abcdefgh")
    assert feed.store.purge("1") == 2 and feed.store.purge("1") == 0
    assert sorted(statuses(feed.store)) == list("adefgh") and feed.keys() == list("abcdefgh")


def test_a_failed_merge_leaves_the_old_state(spark, feed, monkeypatch):
    feed.store.add_batch(delivery(spark, ["a", "b"], 1), "s", 0)
    monkeypatch.setattr(feed.store.versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError, match="no space"):
        feed.store.update_status(spark.createDataFrame([("a", "failed")], "sample_hash string, new_status string"))
    assert statuses(feed.store) == {"a": "pending", "b": "pending"}


def test_of_two_writers_one_starts_again(spark, feed, monkeypatch):
    store, other = feed.store, SampleStore(spark, feed.store.path, 1)
    whole, calls = store.versions.commit, []

    def late(after, state):
        calls.append(after)
        if len(calls) == 1:  # the other stream comes first with the same key
            other.add_batch(delivery(spark, ["a"], 1), "two", 0)
        whole(after, state)

    monkeypatch.setattr(store.versions, "commit", late)
    inserted = store.add_batch(delivery(spark, ["a", "b"], 1), "one", 0)
    assert [r.sample_hash for r in inserted.collect()] == ["b"] and len(calls) == 2
    assert feed.keys() == feed.keys("keys") == ["a", "b"]
    with pytest.raises(Conflict):
        whole(0, {})


def test_a_failed_cycle_is_kept_and_the_stream_goes_on(spark, feed, tmp_path, monkeypatch):
    feed.send(["a"], 1)
    feed.send(["b"], 2)
    whole, failed = feed.store.add_batch, str(tmp_path / "failed")

    def add(rows, stream, batch):
        if batch == 0:
            raise OSError("disk gone")
        return whole(rows, stream, batch)

    monkeypatch.setattr(feed.store, "add_batch", add)
    feed.run(failed_batches=failed)
    (kept,) = spark.read.parquet(failed).select("sample_hash", "error").collect()
    assert {kept.sample_hash, *feed.keys()} == {"a", "b"} and kept.error == "OSError: disk gone"


@pytest.mark.parametrize("files", [1, 1000])
def test_drop_repeats_keeps_late_new_keys(spark, feed, tmp_path, files):
    for keys, minute in ((["a", "b", "a"], 600), (["b", "c"], 601), (["late"], 1), (["c", "d"], 602)):
        feed.send(keys, minute)
    fresh = drop_repeats(read_deliveries(spark, feed.path, files_per_cycle=files))
    writer = fresh.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sample_hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d", "late"]


def test_log_files_arrive_whole(spark, tmp_path):
    (tmp_path / "in" / "t1").mkdir(parents=True)
    (tmp_path / "in" / "t1" / "a b.log").write_text("x\ny\n")
    rows = read_log_files(spark, str(tmp_path / "in"))
    query = rows.writeStream.format("memory").queryName("log_files").trigger(availableNow=True).start()
    query.awaitTermination()
    (row,) = spark.table("log_files").collect()
    assert row.content == "x\ny\n" and row.file_size == 4 and row.file.endswith("/t1/a%20b.log")
