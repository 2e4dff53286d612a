"""The full profile of samples, one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.operators.fields import with_schema
from logprism.operators.formats import with_format
from logprism.operators.hints import with_hints
from logprism.operators.lines import with_lines
from logprism.operators.signals import WORTH_SCORE, with_signals
from logprism.operators.stats import with_stats

PROFILE_VERSION = "1"


def profile(
    samples: DataFrame,
    *,
    worth_score: float = WORTH_SCORE,
    stat_lines: int | None = None,
    probe_lines: int | None = None,
    schema_lines: int | None = None,
    analyzed_at: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One ``sample_metadata`` row per sample (``sample_hash, target_id,
    sample_content``), whatever the sample's status; ``keep`` passes columns through.
    Figures are of the whole text. ``stat_lines``, ``probe_lines`` and ``schema_lines``
    restrict statistics, format detection and field schema to the first lines.

    Every stage works on the row's own arrays: scan, profile and write are one
    stage without an exchange, and its cost is spread as the input files are.
    """
    staged = with_hints(
        with_schema(
            with_signals(
                with_stats(with_format(with_lines(samples, stat_lines), probe_lines)), worth_score
            ),
            schema_lines,
        )
    )
    return staged.select(
        "sample_hash",
        "target_id",
        (F.current_timestamp() if analyzed_at is None else analyzed_at).alias("analyzed_at"),
        F.lit(PROFILE_VERSION).alias("preprocessing_version"),
        "format",
        "stats",
        "agentic_scan",
        "schema",
        "ingestion_hints",
        F.lit("pending").alias("classification_status"),
        *keep,
    )


def profile_metrics(metadata: DataFrame) -> DataFrame:
    """Profiled samples per target, and how many of them are worth classifying."""
    worth = F.col("ingestion_hints.worth_classifying")
    return metadata.groupBy("target_id").agg(
        F.count("*").alias("processed"),
        F.count_if(worth).alias("agentic"),
        F.count_if(~worth).alias("not_agentic"),
    )
