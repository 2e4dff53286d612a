"""Line statistics and severity distribution of a sample's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.arrays import count_where, ratio
from logprism.functions.level_table import LABELS, json_level, logfmt_level, plain_level, syslog_level
from logprism.functions.plan import computed_once
from logprism.operators.formats import with_format
from logprism.operators.lines import with_lines


def _levels_of(texts: Column, log_type: str) -> Column:
    """The level of each text, as lines of a format tell it."""
    if log_type == "json":
        return F.transform(texts, json_level)
    if log_type == "logfmt":
        return F.transform(texts, logfmt_level)
    # Nested, because a lambda evaluates what it repeats each time it stands there.
    if log_type == "syslog":
        pairs = F.transform(texts, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
        return F.transform(pairs, lambda p: syslog_level(p.line, p.low))
    return F.transform(F.transform(texts, F.lower), plain_level)


def with_levels(df: DataFrame) -> DataFrame:
    """Add ``levels``: per non-blank line its level label, null where there is none."""
    texts, log_type = F.col("stat_texts"), F.col("log_type")
    levels = (
        F.when(log_type == "json", _levels_of(texts, "json"))
        .when(log_type == "logfmt", _levels_of(texts, "logfmt"))
        .when(log_type == "syslog", _levels_of(texts, "syslog"))
        .otherwise(_levels_of(texts, "plain_text"))
    )
    return df.withColumn("levels", levels)


def _lines_at(label: str) -> Column:
    return count_where(F.col("levels"), lambda x: x == label)


def with_stats(df: DataFrame) -> DataFrame:
    """Add the struct ``stats`` to a frame that has lines and ``log_type``."""
    total = F.size("stat_lines").cast("bigint")
    texts = F.col("stat_texts")
    filled = F.size(texts).cast("bigint")
    bytes_total = F.aggregate(texts, F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x))
    # One expression per label, not a lambda over labels: Catalyst would inline the
    # reading of the levels into the lambda and redo it for each label.
    counts = F.array(
        *[F.struct(F.lit(label).alias("level"), _lines_at(label).alias("n")) for label in LABELS]
    )
    measured = with_levels(df).withColumn(
        "stats",
        F.struct(
            total.alias("total_lines"),
            filled.alias("non_empty_lines"),
            ratio(total - filled, total).alias("empty_line_ratio"),
            ratio(bytes_total, filled).alias("avg_line_length"),
            F.lit(None).cast("bigint").alias("time_span_secs"),
            F.map_from_entries(F.filter(counts, lambda c: c.n > 0)).alias("level_distribution"),
            ratio(F.size(F.array_distinct(texts)), filled).alias("unique_line_ratio"),
        ),
    )
    return computed_once(measured.drop("levels"))


def line_stats(samples: DataFrame, stat_lines: int | None = None) -> DataFrame:
    """Line counts, mean length in bytes and share of distinct lines, per sample."""
    # These figures do not depend on the format, so its detection is left out.
    plain = with_lines(samples, stat_lines).withColumn("log_type", F.lit("plain_text"))
    return with_stats(plain).select("sample_hash", "stats.*").drop("level_distribution")


def line_levels(samples: DataFrame, log_type: str, stat_lines: int | None = None) -> DataFrame:
    """Level of every non-blank line, read as one given format says.

    ``line_no`` counts the non-blank lines, from 0.
    """
    lines = with_lines(samples, stat_lines).withColumn("levels", _levels_of(F.col("stat_texts"), log_type))
    rows = computed_once(lines).select("sample_hash", F.posexplode("levels").alias("line_no", "level"))
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


def level_distribution(samples: DataFrame, stat_lines: int | None = None) -> DataFrame:
    """Long form of the distribution: ``sample_hash, level, n`` with n > 0."""
    stats = with_stats(with_format(with_lines(samples, stat_lines)))
    return stats.select("sample_hash", F.explode("stats.level_distribution").alias("level", "n"))
