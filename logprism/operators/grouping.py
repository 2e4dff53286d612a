"""Taking the first rows of each group without gathering a group anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 1024


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int | Column, part: Column | None = None
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered from 1 in ``rank``.

    For a literal ``n`` Spark cuts every task's rows to ``n`` per group before the
    shuffle (WindowGroupLimit), so a hot group never meets in one task. Where ``n`` is a
    column, ``part`` must tell the parts of a group: each part is ranked on its own,
    and only the parts' first rows are then ranked together.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    if part is None:
        if not isinstance(n, int):
            raise ValueError("a varying number of rows needs parts to rank first")
        return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
    limited = df.withColumn("_limit", F.lit(n)).withColumn("_part", part)
    in_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    for window in (in_part, whole):
        limited = limited.withColumn("rank", F.row_number().over(window)).where("rank <= _limit")
    return limited.drop("_limit", "_part")


def hashed_part(*columns: str) -> Column:
    """A part for groups without a natural division: one of 1,024 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS))
