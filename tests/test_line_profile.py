"""The profile from a table of lines against the profile of whole texts."""

import pytest
from pyspark.sql import functions as F

from logprism.operators.lines import lines_explode
from logprism.plans import line_profile
from logprism.plans.line_profile import profile_lines
from logprism.plans.profile import profile
from logprism.sources.files import number_lines, scan_lines

TEXTS = {
    "empty": "",
    "blank": "\n \n\t\n",
    "json": '{"ts":1,"level":"WARN","msg":"a"}\n\n{"Level":"error","id":null}\n{"id":[1]}\n{broken}\nopenai call',
    "second role": '{"a":{"time":1}}\n{"severity":"info","level":"bogus"}\n{"severity":"fatal"}',
    "repeated key": '{"k":1,"k":"x"}\n{"k":2}\n{}\n{"k":true}',
    "logfmt": "level=info msg=x user_id=7\nlevel=warn msg=y a=\nlevel=info msg=x user_id=7\r\nlvl=err t=1.5 b=true",
    "syslog": "<34>Oct 1 host su: failed\nJan 2 host x: WARNING: y\nMarble is no month\n<999>",
    "multiline": "Traceback\n  at one\n\tat two\n  at three\n  at four\nrag and plan",
    "plain": "ERROR: first\n[warn] PLAN Karl\nOPENAİ\nprompt_tokens=3 total_tokens\n\xa0\n",
    "copies": "same line\n" * 50,
}


def columns(frame):
    rows = frame.select("sample_hash", "target_id", "format", "stats", "agentic_scan", "schema", "ingestion_hints",
                        "preprocessing_version", "classification_status").collect()
    return {r.sample_hash: r.asDict(recursive=True) for r in rows}


@pytest.fixture
def samples(spark):
    return spark.createDataFrame([(k, "t", v) for k, v in TEXTS.items()], "sample_hash string, target_id string, sample_content string")


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_profile_of_whole_texts(samples, parts):
    lines = lines_explode(samples).repartition(parts)  # the lines of a text on many tasks, out of order
    assert columns(profile_lines(samples, lines)) == columns(profile(samples))


def test_lines_of_files(spark, tmp_path):
    """A file of many blocks equals the sample that holds all of it."""
    rows = [f'{{"level":"{("info", "error")[i % 7 == 0]}","n":{i},"msg":"step {i % 90}"}}' for i in range(4000)]
    folder = tmp_path / "t" / "var"
    folder.mkdir(parents=True)
    (folder / "a.log").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        scan = number_lines(scan_lines(spark, str(tmp_path)))
        # file rows count from 1
        lines = scan.select(F.col("path").alias("sample_hash"), (F.col("line_no") - F.lit(1)).alias("line_no"), F.col("value").alias("line"))
        assert scan.select("block_start").distinct().count() > 5 and lines.agg(F.min("line_no")).first()[0] == 0
        texts = lines.select("sample_hash", F.lit("t").alias("target_id")).distinct()
        got = columns(profile_lines(texts, lines))
        whole = spark.createDataFrame([(key, "t", "\n".join(rows) + "\n") for key in got], "sample_hash string, target_id string, sample_content string")
        assert len(got) == 1 and got == columns(profile(whole))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_lines_at_all(spark, samples):
    none = lines_explode(samples).where("false")
    got = columns(profile_lines(samples, none))
    assert set(got) == set(TEXTS)
    assert all(r["stats"]["total_lines"] == 0 and r["schema"] is None for r in got.values())
    assert profile_lines(samples.where("false"), none).count() == 0


def test_sketch_error(spark):
    """Estimates of one text with most lines and of small ones are within 3 %."""
    lines = spark.range(230_000).select(
        F.when(F.col("id") < 200_000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("sample_hash"),
        F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id") % 60_000).alias("line"))
    exact = dict(line_profile.distinct_lines(lines, ["sample_hash"]).collect())
    assert exact["big"] == 60_000
    near = dict(line_profile.distinct_lines(lines, ["sample_hash"], line_profile.SKETCH_BITS).collect())
    assert set(near) == set(exact) and all(abs(near[k] / exact[k] - 1) < 0.03 for k in exact)


def test_states_are_counted_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("h", 0, "x")], "sample_hash string, line_no long, line string").write.parquet(path)
    lines = spark.read.parquet(path)
    for build in (line_profile.line_counts, line_profile.line_schemas):
        plan = build(lines, ["sample_hash"])._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and "Window" not in plan
    counts = line_profile.line_counts(lines, ["sample_hash"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in counts and counts.count("Exchange") == 1
    sketch = line_profile.distinct_lines(lines, ["sample_hash"], 14)._jdf.queryExecution().executedPlan().toString()
    assert sketch.count("Exchange") == 1


def test_free_text_levels_are_read_once(spark):
    lines = lines_explode(spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "sample_hash string, sample_content string"))
    plan = line_profile.line_counts(lines, ["sample_hash"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[emergency]") == 1
