"""The collection cycle: from targets and their files to stored, profiled, gated samples."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logprism.operators.sampling import SAMPLE_LINES, directory_outcomes, sample_files, to_samples
from logprism.plans.profile import profile_metrics
from logprism.sources.files import PATTERNS, discover_files, list_tree, read_lines
from logprism.sources.shared import shared_folder
from logprism.sources.targets import active_targets, validate_targets
from logprism.streaming.ingest import SampleStore


def collect(
    spark: SparkSession,
    targets: DataFrame,
    root: str,
    *,
    mode: str = "both",
    n: int = SAMPLE_LINES,
    patterns: tuple[str, ...] = PATTERNS,
    max_depth: int | None = None,
    timestamp: Column | None = None,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Samples of all files of valid targets, and rows for directories that gave none.

    ``targets`` are valid ones (``connect_error``, where present, tells an unreachable
    host); ``root`` holds a folder per target with that host's files. ``inventory``
    replaces the listing of ``root`` (:func:`logprism.sources.files.list_tree`). Empty
    files, files that cannot be read and directories that cannot be listed are rows too.
    """
    if "connect_error" not in targets.columns:
        targets = targets.withColumn("connect_error", F.lit(None).cast("string"))
    tree = list_tree(spark, root) if inventory is None else inventory
    listed = tree.where("kind = 'file'").select("target_id", "path", "size")
    reachable = targets.where(F.col("connect_error").isNull())
    # Found once: what is read, what is reported and what a directory lacks are told from the same files.
    path, found = shared_folder(spark, f"found-{uuid.uuid4().hex}"), discover_files(reachable, listed, patterns=patterns, max_depth=max_depth)
    found.write.parquet(path)
    files = spark.read.schema(found.schema).parquet(path)
    sampled = sample_files(files, read_lines(files.dropDuplicates(["target_id", "path"]), root), mode, n)
    asked = reachable.select("target_id", F.explode("log_paths").alias("directory"), F.regexp_replace("directory", "/+$", "").alias("path")).distinct()
    folders = tree.where("kind = 'directory'").select("target_id", "path", F.col("error").alias("list_error"))
    there = asked.join(folders, ["target_id", "path"]).select("target_id", "directory", "list_error")
    outcomes = directory_outcomes(targets, there, files, mode)
    return to_samples(sampled.unionByName(outcomes), timestamp)


@dataclass(frozen=True)
class CycleResult:
    """What a cycle did. ``failed`` counts samples that could not be read."""

    rejected_targets: int
    collected: int
    failed: int
    inserted: int
    duplicates: int
    seconds: float


def run_cycle(
    store: SampleStore, raw_targets: DataFrame, root: str, *, cycle: str, **options
) -> CycleResult:
    """Collect from all active, valid targets and add to the store what it lacks.

    ``cycle`` names this run; a run that was added under its name is not added again, and
    its figures are those of the first time.
    """
    started, spark = time.monotonic(), store.spark
    valid, rejects = validate_targets(active_targets(raw_targets))
    inserted = store.add_batch(collect(spark, valid, root, **options), cycle, 0).count()
    counts = store.arrived(cycle).agg(F.count("*").alias("n"), F.count_if(F.col("processing_status") == "error").alias("failed")).first()
    return CycleResult(rejects.count(), counts.n, counts.failed, inserted, counts.n - inserted, time.monotonic() - started)


def cycle_metrics(store: SampleStore) -> DataFrame:
    """Per target: samples, read errors, and the counters of their profiles."""
    read = store.read("samples").groupBy("target_id").agg(
        F.count("*").alias("samples"), F.count_if(F.col("processing_status") == "error").alias("errors")
    )
    return read.join(profile_metrics(store.read("metadata")), "target_id", "left")
