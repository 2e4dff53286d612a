"""Alerts from classifications: selection and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logprism.operators.classify import severity_rank

EVENT = "classification.alert"
# Sign of each severity, and how many items a message lists.
EMOJI = {"critical": "\U0001f6a8", "warning": "⚠️", "info": "ℹ️"}
NORMAL_EMOJI = "✅"
TOP_FINDINGS, TOP_RECOMMENDATIONS = 5, 3


def select_alerts(classifications: DataFrame, threshold: str = "critical") -> DataFrame:
    """Classifications at least as severe as ``threshold``."""
    return classifications.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(threshold)))


def alert_payload(alerts: DataFrame) -> DataFrame:
    """``sample_hash`` and the JSON event for a webhook, nulls kept."""
    event = F.struct(
        F.lit(EVENT).alias("event"),
        "severity",
        "target_id",
        "sample_hash",
        F.date_format("classified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("classified_at"),
        "summary",
        "categories",
        "key_findings",
        "recommendations",
        "confidence",
        "model",
        "input_tokens",
        "output_tokens",
    )
    return alerts.select("sample_hash", F.to_json(event, {"ignoreNullFields": "false"}).alias("payload"))


def alert_text(
    alerts: DataFrame, product: str = "logprism", findings: int = TOP_FINDINGS, recommendations: int = TOP_RECOMMENDATIONS
) -> DataFrame:
    """``sample_hash, title, body`` of a chat message, which lists the first findings and recommendations."""
    emoji = F.when(F.col("severity").isNull(), F.lit(NORMAL_EMOJI))
    for severity, sign in EMOJI.items():
        emoji = emoji.when(F.col("severity") == severity, F.lit(sign))
    finding = F.transform(
        F.slice("key_findings", 1, findings),
        lambda f: F.concat(
            F.lit("• *"), f.pattern, F.lit("* ×"), f["count"].cast("string"),
            F.lit(" — _"), f.severity, F.lit("_"),
        ),
    )
    advice = F.transform(
        F.slice("recommendations", 1, recommendations), lambda r: F.concat(F.lit("→ "), r)
    )

    def section(heading: str, items, source: str):
        text = F.concat(F.lit(f"\n*{heading}:*\n"), F.array_join(items, "\n"))
        return F.when(F.size(source) > 0, text).otherwise(F.lit(""))

    percent = F.round(F.col("confidence") * 100, 0).cast("int").cast("string")
    return alerts.select(
        "sample_hash",
        F.concat(
            emoji.otherwise(F.lit(NORMAL_EMOJI)), F.lit(f" {product}: "), F.upper("severity"),
            F.lit(" finding on "), "target_id",
        ).alias("title"),
        F.concat(
            F.lit("*Target:* `"), "target_id", F.lit("`\n*Summary:* "), "summary",
            section("Key findings", finding, "key_findings"),
            section("Recommendations", advice, "recommendations"),
            F.lit("\n*Confidence:* "), percent, F.lit("%  |  *Model:* `"), "model", F.lit("`"),
        ).alias("body"),
    )
