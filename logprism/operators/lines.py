"""Samples to lines.

A sample is one row holding its whole text, so everything about one sample is
computed from arrays in that row. The profile operators are narrow: they add
columns, shuffle nothing, and no target or copy can be a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.text import is_blank, split_lines, utrim


def first_items(items: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all of them without ``n``."""
    return items if n is None else F.slice(items, 1, n)


def with_lines(samples: DataFrame, stat_lines: int | None = None) -> DataFrame:
    """Add ``lines`` (all of them), ``trimmed`` (the non-blank ones, trimmed), and
    ``stat_lines`` / ``stat_texts``: the lines that statistics look at, by default all,
    and the non-blank ones among these."""
    return (
        samples.withColumn("lines", split_lines(F.col("sample_content")))
        .withColumn("trimmed", F.filter(F.transform("lines", utrim), lambda x: x != ""))
        .withColumn("stat_lines", first_items(F.col("lines"), stat_lines))
        .withColumn("stat_texts", F.filter("stat_lines", lambda x: ~is_blank(x)))
    )


def lines_explode(samples: DataFrame) -> DataFrame:
    """One row per line: ``sample_hash, line_no`` (from 0) and ``line``."""
    lines = split_lines(F.col("sample_content"))
    rows = samples.select("sample_hash", F.posexplode(lines).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))
