"""Profile the samples that have no metadata yet."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from logprism.operators.store import purge_stale, unprocessed_samples
from logprism.plans.profile import PROFILE_VERSION, profile


def backfill(
    samples: DataFrame, metadata: DataFrame, *, reprocess_stale: bool = False, limit: int | None = None
) -> DataFrame:
    """Metadata rows to add: one anti join and one narrow profile, no paging.

    With ``reprocess_stale`` metadata of other versions counts as missing.
    """
    if reprocess_stale:
        metadata, _ = purge_stale(metadata, PROFILE_VERSION)
    return profile(unprocessed_samples(samples, metadata, limit))


def backfill_summary(rows: DataFrame) -> DataFrame:
    """Of metadata rows to add, one row: ``attempted`` and ``agentic`` ones."""
    worth = F.col("ingestion_hints.worth_classifying")
    return rows.agg(F.count("*").alias("attempted"), F.count_if(worth).alias("agentic"))


@dataclass(frozen=True)
class BackfillResult:
    attempted: int
    written: int
    failed: int
    agentic: int
    seconds: float
    error: str | None = None


def run_backfill(
    samples: DataFrame,
    metadata: DataFrame,
    path: str,
    *,
    dry_run: bool = False,
    reprocess_stale: bool = False,
    limit: int | None = None,
) -> BackfillResult:
    """Write the missing metadata to a new folder and count what was read back from it.

    Spark commits all rows or none, so a failed write counts every attempted row as
    failed, with the error. A dry run only counts what it would attempt.
    """
    started = time.monotonic()
    rows = backfill(samples, metadata, reprocess_stale=reprocess_stale, limit=limit)
    if dry_run:
        planned = backfill_summary(rows).first()
        return BackfillResult(planned.attempted, 0, 0, planned.agentic, time.monotonic() - started)
    try:
        rows.write.mode("errorifexists").parquet(path)
    except Exception as error:  # noqa: BLE001 - reported, as a caller goes on with other work
        known = metadata if not reprocess_stale else purge_stale(metadata, PROFILE_VERSION)[0]
        attempted = unprocessed_samples(samples.select("sample_hash", "timestamp"), known, limit).count()
        return BackfillResult(attempted, 0, attempted, 0, time.monotonic() - started, f"{type(error).__name__}: {error}"[:2000])
    done = backfill_summary(samples.sparkSession.read.parquet(path)).first()
    return BackfillResult(done.attempted, done.attempted, 0, done.agentic, time.monotonic() - started)
