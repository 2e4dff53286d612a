"""What to do with a sample: which prompt, how many lines, worth it or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.text import four_decimals

MIN_UNIQUE_RATIO = 0.05
MIN_LINE_LENGTH = 10.0

# Prompt template and lines per prompt of each format.
TEMPLATES = {"json": "json_agent", "logfmt": "logfmt_agent", "syslog": "syslog"}
CHUNK_LINES = {"json": 20, "logfmt": 30, "syslog": 50, "multiline": 10}
GENERIC_TEMPLATE, GENERIC_CHUNK = "generic", 40
# The reasons for leaving a sample out.
NO_LINES = "sample has no non-empty lines"
REPETITIVE = "sample is highly repetitive (unique_line_ratio < 0.05)"
TOO_SHORT = "average line length too short to be informative"


def _lookup(key: Column, values: dict, default) -> Column:
    result = F.lit(default)
    for name, value in values.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def with_hints(df: DataFrame) -> DataFrame:
    """Add the struct ``ingestion_hints``; needs log_type, stats and agentic_scan."""
    log_type, scan = F.col("log_type"), F.col("agentic_scan")
    skip = (
        F.when(F.col("stats.non_empty_lines") == 0, F.lit(NO_LINES))
        .when(F.col("stats.unique_line_ratio") < MIN_UNIQUE_RATIO, F.lit(REPETITIVE))
        .when(F.col("stats.avg_line_length") < MIN_LINE_LENGTH, F.lit(TOO_SHORT))
    )
    low_score = F.concat(
        F.lit("agentic signal score "), four_decimals(scan.signal_score), F.lit(" is below threshold")
    )
    kept = F.col("_skip").isNull()
    priority = F.least(F.round(scan.signal_score * 100, 0), F.lit(100.0)).cast("int")
    return (
        df.withColumn("_skip", skip)
        .withColumn(
            "ingestion_hints",
            F.struct(
                F.when(kept, _lookup(log_type, TEMPLATES, GENERIC_TEMPLATE))
                .otherwise(F.lit(GENERIC_TEMPLATE))
                .alias("prompt_template"),
                F.when(kept, _lookup(log_type, CHUNK_LINES, GENERIC_CHUNK))
                .otherwise(F.lit(GENERIC_CHUNK))
                .alias("suggested_chunk_size"),
                (kept & scan.worth_classifying).alias("worth_classifying"),
                F.coalesce(
                    F.col("_skip"), F.when(~scan.worth_classifying, low_score)
                ).alias("skip_reason"),
                F.when(kept, priority).otherwise(F.lit(0)).alias("priority"),
            ),
        )
        .drop("_skip")
    )
