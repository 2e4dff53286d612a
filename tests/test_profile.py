"""The profile against plain Python, on chosen texts and on generated ones."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from logprism.operators.formats import format_detect
from logprism.plans.profile import profile

JSON_LOG = "\n".join(
    '{"time":"2030-01-01T00:00:%02dZ","level":"%s","msg":"%s","run_id":"r%d","n":%d}'
    % (i, ("info", "debug", "Warning")[i % 3], ("tool_call start", "cache miss")[i % 2], i, i)
    for i in range(12)
) + "\n"
TRACE_LOG = """2030-01-01 10:00:00 INFO  worker started
2030-01-01 10:00:01 ERROR job failed: timeout
Traceback (most recent call last):
  File "job.py", line 3, in run
    call(model)
ValueError: rate limit reached
[warn] retrying after 3s
"""
EDGES = [
    "", "\n", "\n\n", "a\r\nb\n c\n", "x\r", "x\r\r\ny", " ", "18°C", " \n　x　\n",
    " \n  \nMarble\nMarket\n",
    "  {a}\n  {b}\n  {c}\n  {d}",
    '{"a":1}\nplain words here',
    '{"x":1}\n{"x":"s"}',
    '{"a":1,"a":2}', '{"a": nope}', '{"a":1,}', '{"a":1}, "b":2}', '{"a\\"b":[1,{"c":2}]}', '{"a":"x\\\\","b":null}',
    '{"a":1,"open}', "{}", '{"":1}', '{"a":NaN,"b":-Infinity}', '{"bad": {"q":1]}, "b":true}',
    "a=1 a=2", "a=1 b=", 'msg="a b=c" level=odd severity=warn', "LEVEL=Info x=.5 y=1e5 z=1d =q t=true",
    "<300>x", "<+13>x", "<13x", "<0013>error: y", "<99999999999>a",
    '{"level":"odd","severity":"warn"}', '{"level" : WARN , "q":1}', '{"lvl":\t"info "}', '{"level":"level":"err"}',
    "Information is here", "an ALERT rose", "x err y", "Traceback", "note: trc: dbg",
    "disk storage full", "Thouſght: ſtep by ſtep", "KRAG", "dıİng PLANé",
    "Action: x", "reasoning : y", 'usage = {', '"name" : "ab_c"', "{a_b} then {c}",
    JSON_LOG, TRACE_LOG, JSON_LOG + TRACE_LOG,
    "\n".join('{"level":"info","msg":"beat"}' for _ in range(20)),
    "\n".join('{"level":"info","msg":"beat"}' for _ in range(21)),
]
for n in (49, 50, 51):
    EDGES.append("\n".join(["{}"] * 26 + ["words"] * (n - 26) + ["{}"] * 10))
for n in (199, 200, 201, 499, 500, 501, 5000):
    EDGES.append("\n".join('{"k%d":%d}' % (i // 200, i) for i in range(n)) + "\n")

PIECES = [
    "{", "}", '"', ":", ",", "\\", "=", " ", "  ", "\t", "\n", "\n", "\r\n", " ", "[", "]", "<", ">", "13", "1.5",
    "level", "severity", '"level":', "level=", "msg=x", "id=7", "info", "ERROR", " warn ", "Jan ", "true", "null",
    "nan", "é", "İ", "rag", "tool_call", "429", '{"a":1}', '{"b":"x","c":[1]}', "Observation :", "x", '\\"',
]


def generated(count: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choices(PIECES, k=rng.randint(1, 60))) for _ in range(count)]


@pytest.fixture(scope="module")
def profiles(spark):
    texts = EDGES + generated(400)
    rows = [(str(i), "t", text) for i, text in enumerate(texts)]
    samples = spark.createDataFrame(rows, "sample_hash string, target_id string, sample_content string")
    found = {int(r.sample_hash): r for r in profile(samples.repartition(8)).collect()}
    assert len(found) == len(texts)
    return [(text, found[i]) for i, text in enumerate(texts)]


def test_format(profiles):
    for text, row in profiles:
        assert row.format.log_type == brute.log_type(text), text


def test_stats(profiles):
    for text, row in profiles:
        got = row.stats.asDict()
        assert got.pop("time_span_secs") is None
        assert got == brute.stats(text), text


def test_scan(profiles):
    for text, row in profiles:
        got = row.agentic_scan.asDict()
        assert got.pop("worth_classifying") == (got["signal_score"] >= 0.02)
        assert got == brute.scan(text), text


def test_schema(profiles):
    for text, row in profiles:
        want = brute.schema(text)
        got = row.schema and ([tuple(f) for f in row.schema.fields], row.schema.sample_coverage)
        assert got == want, text


def test_hints(profiles):
    by_text = dict(profiles)
    assert by_text[""].ingestion_hints.skip_reason == "sample has no non-empty lines"
    assert by_text["18°C"].ingestion_hints.skip_reason.startswith("average line length")
    same = "\n".join('{"level":"info","msg":"beat"}' for _ in range(20))
    assert not by_text[same].ingestion_hints.skip_reason.startswith("sample is highly")
    assert by_text[same + '\n{"level":"info","msg":"beat"}'].ingestion_hints.skip_reason.startswith("sample is highly")
    hints = by_text[JSON_LOG].ingestion_hints
    assert (hints.prompt_template, hints.suggested_chunk_size, hints.priority) == ("json_agent", 20, 50)
    assert hints.worth_classifying and hints.skip_reason is None
    plain = by_text["Information is here"].ingestion_hints
    assert plain.skip_reason == "agentic signal score 0.0000 is below threshold"
    assert (plain.prompt_template, plain.suggested_chunk_size) == ("generic", 40)


def test_field_roles(spark):
    rows = [
        ("json", '{"x":{"ts":"\\"level\\":1"},"Message":"a"}\n{"time":1,"level":2,"msg":3}'),
        ("late", '{"a":1}\n{"Time":1,"SEVERITY":2}'),
        ("logfmt", "a=1 b=2\ntime level=x a=1"),
        ("syslog", "<1>a"),
        ("multiline", "a\n  b\n  c\n  d"),
    ]
    samples = spark.createDataFrame(rows, "sample_hash string, sample_content string").withColumn("target_id", F.lit("t"))
    got = {r.sample_hash: (r.timestamp_field, r.level_field, r.message_field, r.multiline) for r in format_detect(samples).collect()}
    assert got == {
        "json": ("ts", None, "Message", False),
        "late": ("Time", "SEVERITY", None, False),
        "logfmt": ("time", "level", None, False),
        "syslog": ("timestamp", "severity", "message", False),
        "multiline": (None, None, None, True),
    }
