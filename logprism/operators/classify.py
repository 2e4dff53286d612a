"""Choosing samples for classification and reading the model's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.plan import computed_once
from logprism.functions.text import utrim
from logprism.operators.grouping import first_per_group

CLASSIFY_SCORE = 0.05
CLASSIFICATION_VERSION = "1"

# Severities from mild to severe, and what stands in for a summary.
SEVERITIES = ("normal", "info", "warning", "critical")
NO_SUMMARY = "No summary provided."


def pending_classifications(
    metadata: DataFrame, samples: DataFrame, *, limit: int, threshold: float = CLASSIFY_SCORE
) -> DataFrame:
    """The best-scored pending samples, joined with their text.

    The limit is applied to the metadata; rows whose sample is gone then drop out,
    so fewer than ``limit`` may come back.
    """
    score = F.col("agentic_scan.signal_score")
    chosen = (
        metadata.where(
            F.col("ingestion_hints.worth_classifying")
            & (score >= threshold)
            & (F.col("classification_status") == "pending")
        )
        .orderBy(score.desc(), "sample_hash")
        .limit(limit)
    )
    return chosen.join(samples.drop("target_id"), "sample_hash")


def classify_gate(
    arrivals: DataFrame,
    *,
    max_per_cycle: int,
    cycle: str | None = None,
    enabled: bool = True,
    threshold: float = CLASSIFY_SCORE,
) -> DataFrame:
    """Add ``decision`` to samples, in order of arrival within their cycle.

    ``cycle`` names the column that tells a sample's cycle; without it all are one
    cycle. So a decision depends on the data, not on how a stream cut its batches. Every
    sample uses up a place of the cap, also one that then fails the threshold. Spark
    cuts every task's rows to the cap before the shuffle; the admitted are joined back.
    """
    if not enabled:
        return arrivals.withColumn("decision", F.lit("disabled"))
    key = F.lit(0) if cycle is None else F.col(cycle)
    order = [F.col("timestamp"), F.col("sample_hash")]
    narrow = arrivals.select("sample_hash", "timestamp", key.alias("_cycle"))
    admitted = first_per_group(narrow, ["_cycle"], order, max_per_cycle)
    admitted = admitted.select("sample_hash", F.lit(True).alias("_admitted"))
    decision = (
        F.when(F.col("_admitted").isNull(), F.lit("capped"))
        .when(F.col("agentic_scan.signal_score") < threshold, F.lit("below_threshold"))
        .when(F.col("classification_status") == "classified", F.lit("already_classified"))
        .otherwise(F.lit("classify"))
    )
    return arrivals.join(admitted, "sample_hash", "left").withColumn("decision", decision).drop("_admitted")


def strip_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    opened = F.regexp_replace(utrim(text), r"^(```json)+", "")
    return utrim(F.regexp_replace(F.regexp_replace(opened, r"^(```)+", ""), r"(```)+\z", ""))


def parse_value(text: Column) -> Column:
    """The text as one JSON value, null if it is anything else.

    Spark's parser stops after the first value. A rest behind it is found by parsing
    the text as the only item of an array and as the value of an object: no rest can
    close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(listed, "$", "array<variant>")
    keyed = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit("}")))
    return F.when((F.size(items) == 1) & keyed.isNotNull(), F.get(items, F.lit(0)))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column, path: str) -> Column:
    """A member that is a string; null if it is missing or of another type."""
    member = F.try_variant_get(value, path, "variant")
    return F.when(_kind(member) == "STRING", F.try_variant_get(value, path, "string"))


def _items(value: Column, path: str) -> Column:
    member = F.try_variant_get(value, path, "variant")
    items = F.when(_kind(member).startswith("ARRAY"), F.try_variant_get(value, path, "array<variant>"))
    return F.coalesce(items, F.array().cast("array<variant>"))


def _texts(value: Column, path: str) -> Column:
    strings = F.filter(_items(value, path), lambda v: _kind(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def _finding(value: Column) -> Column:
    count = F.try_variant_get(value, "$.count", "variant")
    number = F.when(_kind(count) == "BIGINT", F.try_variant_get(value, "$.count", "bigint"))
    return F.struct(
        F.coalesce(_text(value, "$.pattern"), F.lit("")).alias("pattern"),
        F.when(number >= 0, F.pmod(number, F.lit(1 << 32))).otherwise(F.lit(0)).cast("bigint").alias("count"),
        F.coalesce(_text(value, "$.severity"), F.lit("info")).alias("severity"),
        F.coalesce(_text(value, "$.example"), F.lit("")).alias("example"),
    )


def _confidence(value: Column) -> Column:
    kind = _kind(F.try_variant_get(value, "$.confidence", "variant"))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    number = F.when(numeric, F.try_variant_get(value, "$.confidence", "double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))


def parse_replies(replies: DataFrame, classified_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(classifications, failures)`` from ``sample_hash, target_id, model, text,
    input_tokens, output_tokens``. Missing or mistyped members take their defaults;
    only a reply that is not JSON fails."""
    read = computed_once(replies.withColumn("_v", parse_value(strip_fence(F.col("text")))))
    value = F.col("_v")
    severity = _text(value, "$.severity")
    rows = read.where(value.isNotNull()).select(
        "sample_hash",
        "target_id",
        (F.current_timestamp() if classified_at is None else classified_at).alias("classified_at"),
        "model",
        F.when(severity.isin(*SEVERITIES), severity).otherwise(F.lit("normal")).alias("severity"),
        _texts(value, "$.categories").alias("categories"),
        F.coalesce(_text(value, "$.summary"), F.lit(NO_SUMMARY)).alias("summary"),
        F.transform(_items(value, "$.key_findings"), _finding).alias("key_findings"),
        _texts(value, "$.recommendations").alias("recommendations"),
        _confidence(value).alias("confidence"),
        "input_tokens",
        "output_tokens",
        F.lit(CLASSIFICATION_VERSION).alias("classification_version"),
    )
    failures = read.where(value.isNull()).select(
        "sample_hash", "target_id", F.lit("model returned non-JSON").alias("error")
    )
    return rows, failures


def status_updates(classified: DataFrame, failures: DataFrame) -> DataFrame:
    """What replies do to the status of their samples, for ``store.update_status``."""
    done = classified.select("sample_hash", F.lit("classified").alias("new_status"))
    return done.unionByName(failures.select("sample_hash", F.lit("failed").alias("new_status")))


def severity_rank(severity: Column) -> Column:
    """0 for normal up to 3 for critical; unknown words count as normal."""
    word = F.lower(utrim(severity))
    return F.coalesce(F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), word) - 1, F.lit(0)), F.lit(0)).cast("int")
