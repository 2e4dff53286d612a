"""Steering the optimizer where it would repeat expensive work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows; what is computed below is not computed again above.

    Catalyst pushes filters (also those it infers for ``explode``) through
    projections by copying the projected expressions into them, and inlines a
    column used once into a lambda. For text scans that repeats the scan, in a
    lambda once per element. Neither goes through a projection that holds a
    non-deterministic column, so one is added, used in a filter that is always true,
    and dropped. Filters on input columns stop here too: filter samples before
    profiling them.
    """
    return df.withColumn("_task", F.spark_partition_id()).where(F.col("_task") >= 0).drop("_task")
