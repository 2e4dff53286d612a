"""Prompts for the model that classifies samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.text import four_decimals, split_lines

# Role by template, reply schema, and closing instruction.
ROLES = {
    "json_agent": (
        "You are an expert log analysis system specialising in structured JSON logs. "
        "You detect schema violations, unexpected null fields, latency spikes, error "
        "rate anomalies, and signs of framework-level failures (e.g. LangChain, OpenAI SDK)."
    ),
    "logfmt_agent": (
        "You are an expert log analysis system specialising in logfmt-formatted logs. "
        "You parse key=value pairs to detect errors, retries, high latencies, auth "
        "failures, and service degradation patterns."
    ),
    "syslog": (
        "You are an expert log analysis system specialising in syslog-format logs. "
        "You identify kernel panics, OOM events, cron failures, systemd service "
        "crashes, and facility/severity escalations."
    ),
}
GENERIC_ROLE = (
    "You are an expert log analysis system. You identify errors, warnings, "
    "anomalies, recurring failure patterns, and operational issues in raw log output."
)
REPLY_SCHEMA = """Respond ONLY with valid JSON — no markdown, no commentary — matching this exact schema:
{
  "severity":        "critical|warning|info|normal",
  "categories":      ["error","anomaly","performance","security","..."],
  "summary":         "1-3 sentences describing what you found",
  "key_findings":    [{"pattern":"...","count":0,"severity":"critical|warning|info","example":"verbatim log line"}],
  "recommendations": ["actionable suggestion"],
  "confidence":      0.85
}"""
INSTRUCTION = "Analyse this log sample and return your findings as JSON."
TRUNCATED = "\n[... truncated ...]\n"


def truncate_lines(content: Column, lines: Column, chunk: Column) -> Column:
    """The content if it has at most ``chunk`` lines, else its two ends of half a
    chunk each around a marker."""
    half = F.floor(chunk / 2).cast("int")
    head = F.array_join(F.slice(lines, F.lit(1), half), "\n")
    tail = F.array_join(F.slice(lines, F.size(lines) - half + 1, half), "\n")
    return F.when(F.size(lines) <= chunk, content).otherwise(F.concat(head, F.lit(TRUNCATED), tail))


def system_prompt(template: Column) -> Column:
    role = F.when(template.isNull(), F.lit(GENERIC_ROLE))
    for name, text in ROLES.items():
        role = role.when(template == name, F.lit(text))
    return F.concat(role.otherwise(F.lit(GENERIC_ROLE)), F.lit("\n\n" + REPLY_SCHEMA))


def truncate_samples(profiled: DataFrame) -> DataFrame:
    """Samples with ``content``, cut to their suggested chunk. Needs
    ``sample_content`` and ``ingestion_hints``."""
    return profiled.withColumn("_lines", split_lines(F.col("sample_content"))).withColumn(
        "content",
        truncate_lines(
            F.col("sample_content"), F.col("_lines"), F.col("ingestion_hints.suggested_chunk_size")
        ),
    ).drop("_lines")


def build_prompts(profiled: DataFrame) -> DataFrame:
    """``sample_hash, target_id, system, user`` for samples with their metadata, such
    as pending ones.

    Sections without anything to say are left out: ``concat_ws`` skips nulls.
    """
    scan = F.col("agentic_scan")
    header = F.concat(
        F.lit("## Log sample\n\nTarget: "), "target_id", F.lit("\nHost: "), "host",
        F.lit("\nFile: "), "source_file",
    )
    signals = F.concat(
        F.lit("## Preprocessor signals\n\nMatched patterns: "),
        F.array_join(scan.matched_patterns, ", "),
        F.lit("\nSignal score: "),
        four_decimals(scan.signal_score),
    )
    frameworks = F.concat(
        F.lit("Detected frameworks: "), F.array_join(scan.detected_frameworks, ", ")
    )
    user = F.concat_ws(
        "\n\n",
        header,
        F.when(F.size(scan.matched_patterns) > 0, signals),
        F.when(F.size(scan.detected_frameworks) > 0, frameworks),
        F.concat(F.lit("## Content\n\n"), "content"),
        F.lit(INSTRUCTION),
    )
    return truncate_samples(profiled).select(
        "sample_hash",
        "target_id",
        system_prompt(F.col("ingestion_hints.prompt_template")).alias("system"),
        user.alias("user"),
    )
