import datetime as dt
import json

from pyspark.sql import functions as F

from logprism.functions.text import four_decimals
from logprism.operators import alerts, classify, listing, prompts

FULL = {"severity": "warning", "categories": ["a", 1, "b"], "summary": "s", "confidence": 1.5,
        "key_findings": [{"pattern": "p", "count": 3, "severity": "info", "example": "e"}, 5, {"count": -1}, {"count": 2.0}],
        "recommendations": ["r", None]}


def parse(spark, *texts):
    rows = [(str(i), "t", "m", text, 1, 2) for i, text in enumerate(texts)]
    schema = "sample_hash string, target_id string, model string, text string, input_tokens long, output_tokens long"
    good, bad = classify.parse_replies(spark.createDataFrame(rows, schema))
    return {int(r.sample_hash): r for r in good.collect()}, {int(r.sample_hash) for r in bad.collect()}


def test_full_reply(spark):
    text = json.dumps(FULL)
    good, bad = parse(spark, text, f"```json\n{text}\n```", f"  ```{text}``` ", f"``````json{text}")
    assert bad == {3}  # the fence marks come in the order they are stripped
    for i in range(3):
        row = good[i]
        assert (row.severity, row.categories, row.summary, row.confidence) == ("warning", ["a", "b"], "s", 1.0)
        assert [tuple(f) for f in row.key_findings] == [
            ("p", 3, "info", "e"), ("", 0, "info", ""), ("", 0, "info", ""), ("", 0, "info", "")]
        assert row.recommendations == ["r"] and row.classification_version == "1"


def test_defaults(spark):
    for row in parse(spark, "{}", "[1]", "7", '"x"', "null", '{"severity":"Critical","confidence":"high","categories":{}}')[0].values():
        assert (row.severity, row.categories, row.summary, row.confidence) == ("normal", [], classify.NO_SUMMARY, 0.0)
        assert row.key_findings == [] and row.recommendations == []


def test_replies_that_fail(spark):
    good, bad = parse(spark, "oops", "", '{"a":1} and more', '{"a":1}{"b":2}', "1, 2", '{"a":1}] [', '{"a":1}} {', '{"a":')
    assert good == {} and bad == set(range(8))


def test_gate(spark):
    rows = [(f"h{i:02}", dt.datetime(2030, 1, 1, 0, i), 0.01 if i == 1 else 0.5, "classified" if i == 2 else "pending") for i in range(6)]
    batch = spark.createDataFrame(rows, "sample_hash string, timestamp timestamp, signal_score double, classification_status string")
    batch = batch.withColumn("agentic_scan", F.struct("signal_score")).repartition(4)
    got = [r.decision for r in classify.classify_gate(batch, max_per_cycle=4).orderBy("sample_hash").collect()]
    assert got == ["classify", "below_threshold", "already_classified", "classify", "capped", "capped"]
    assert {r.decision for r in classify.classify_gate(batch, max_per_cycle=10, enabled=False).collect()} == {"disabled"}


def test_truncate(spark):
    for n, chunk in ((20, 20), (21, 20), (9, 4), (0, 10)):
        lines = [f"l{i}" for i in range(n)]
        text = "\n".join(lines)
        row = spark.createDataFrame([(text, lines, chunk)], "c string, l array<string>, k int")
        got = row.select(prompts.truncate_lines(F.col("c"), F.col("l"), F.col("k"))).first()[0]
        half = chunk // 2
        want = text if n <= chunk else "\n".join(lines[:half]) + "\n[... truncated ...]\n" + "\n".join(lines[-half:])
        assert got == want


def test_four_decimals(spark):
    values = [0.03125, 0.09375, 0.5, 1 / 3, 0.0, 1.0, 17 / 32, 0.15625]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(four_decimals(F.col("v"))).collect()] == [f"{v:.4f}" for v in values]


def test_ranks_and_alert_text(spark):
    words = [" Critical ", "warning", "INFO", "odd", None]
    frame = spark.createDataFrame([(w,) for w in words], "severity string")
    assert [r[0] for r in frame.select(classify.severity_rank(F.col("severity"))).collect()] == [3, 2, 1, 0, 0]
    good, _ = classify.parse_replies(spark.createDataFrame(
        [("h", "t", "m", json.dumps({**FULL, "severity": "critical", "confidence": 0.125}), 1, 2)],
        "sample_hash string, target_id string, model string, text string, input_tokens long, output_tokens long"))
    row = alerts.alert_text(alerts.select_alerts(good)).first()
    assert row.title == "\U0001f6a8 logprism: CRITICAL finding on t"
    assert "• *p* ×3 — _info_" in row.body and "*Confidence:* 13%  |  *Model:* `m`" in row.body
    payload = json.loads(alerts.alert_payload(good).first().payload)
    assert payload["event"] == "classification.alert" and payload["key_findings"][0]["count"] == 3


def test_sizes_and_lines(spark):
    sizes = spark.createDataFrame([(v,) for v in (None, 0, 1023, 1024, 1280, 1048575, 5 << 20)], "v long")
    got = [r[0] for r in sizes.select(listing.size_label(F.col("v"))).collect()]
    assert got == ["—", "0B", "1023B", "1.0KB", "1.3KB", "1024.0KB", "5.0MB"]
    lines = spark.createDataFrame([(i, f"l{i} \t") for i in range(9)], "n long, line string")
    assert [r.line for r in listing.log_tail(lines, ["n"], 3).collect()] == ["l6", "l7", "l8"]
