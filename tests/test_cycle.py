"""The collection cycle over files on disk."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logprism.plans.cycle import collect, cycle_metrics, run_cycle
from logprism.sources.targets import read_targets, validate_targets
from logprism.streaming.ingest import SampleStore

NOW = dt.datetime(2030, 1, 1)


@pytest.fixture
def hosts(spark, tmp_path):
    files = {
        "web/var/log/app.log": "openai chat.completions call\nerror: rate limit\n" * 40,
        "web/var/log/deep/er/x y.out": "one\ntwo\n",
        "db/var/log/app.log": "nothing of note here\n" * 3,
        "db/var/log/skip.bin": "binary",
    }
    for name, text in files.items():
        file = tmp_path / "hosts" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    documents = [
        {"document_id": "1", "target_id": "web", "status": "active", "host": "w", "username": "u", "log_paths": ["/var/log", "/none"], "sample_line_count": 2},
        {"document_id": "2", "target_id": "db", "status": "active", "host": "d", "username": "u", "log_paths": ["/var/log/"]},
        {"document_id": "3", "target_id": "off", "status": "paused", "host": "d", "username": "u", "log_paths": ["/var/log"]},
        {"document_id": "4", "target_id": "bad", "status": "active", "log_paths": ["/var/log"]},
    ]
    raw = read_targets(spark.createDataFrame([(json.dumps(x),) for x in documents], "document string"))
    return str(tmp_path / "hosts"), raw


def test_collect(spark, hosts):
    root, raw = hosts
    valid, _ = validate_targets(raw)
    rows = {(r.target_id, r.source_file): r for r in collect(spark, valid, root, mode="first", timestamp=F.lit(NOW)).collect()}
    assert set(rows) == {("web", "/var/log/app.log"), ("web", "/var/log/deep/er/x y.out"), ("web", "/none"), ("db", "/var/log/app.log")}
    assert rows["web", "/var/log/app.log"].sample_content == "openai chat.completions call\nerror: rate limit\n"
    assert rows["web", "/var/log/app.log"].line_count == 80
    assert rows["db", "/var/log/app.log"].sample_content.count("\n") == 3
    assert rows["web", "/none"].processing_status == "missing_directory"
    down = valid.withColumn("connect_error", F.when(F.col("target_id") == "db", F.lit("refused")))
    rows = {(r.target_id, r.source_file): r for r in collect(spark, down, root).collect()}
    assert rows["db", "__target__"].error_details == "refused" and ("db", "/var/log/app.log") not in rows


def test_cycles_add_only_what_is_new(spark, hosts, tmp_path):
    root, raw = hosts
    store = SampleStore(spark, str(tmp_path / "store"), 1)
    first = run_cycle(store, raw, root, cycle="1", timestamp=F.lit(NOW))
    assert (first.rejected_targets, first.collected, first.inserted, first.duplicates, first.failed) == (1, 4, 4, 0, 0)
    with open(f"{root}/db/var/log/app.log", "a") as log:
        log.write("one more line\n")
    second = run_cycle(store, raw, root, cycle="2", timestamp=F.lit(NOW))
    assert (second.inserted, second.duplicates) == (1, 3)
    assert run_cycle(store, raw, root, cycle="2", timestamp=F.lit(NOW)).inserted == 1  # repeated under its name
    counts = {r.target_id: (r.samples, r.errors, r.processed) for r in cycle_metrics(store).collect()}
    assert counts == {"web": (3, 0, 3), "db": (2, 0, 2)}


def test_files_are_found_and_counted_once(spark, hosts):
    root, raw = hosts
    plan = collect(spark, validate_targets(raw)[0], root, timestamp=F.lit(NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.count("MapInArrow") == 1
