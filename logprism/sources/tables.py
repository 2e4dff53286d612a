"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None, parts: int | None = None) -> DataFrame:
    """A parquet table.

    A scan has at most one busy task per row group. Where a table has few of them and
    much work follows, ``parts`` asks for so many tasks, spread by the key ``spread_by``.
    """
    rows = spark.read.parquet(path)
    return rows if parts is None else rows.repartition(parts, spread_by)
