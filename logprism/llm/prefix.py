"""Prefix sums in groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def prefix_sums(rows: DataFrame, group: str, block: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows before each row in its group.

    A group is ordered by ``block``, then by ``order``. Blocks are summed first (a row
    per block and group), so that each task numbers single blocks only. ``group``,
    ``block`` and ``amount`` hold no nulls; ``amount`` is a long.
    """
    blocks = rows.groupBy(group, block).agg(F.sum(amount).alias("_block_sum"))
    earlier = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(group, block, F.coalesce(F.sum("_block_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(blocks, [group, block]).withColumn(
        name, F.col("_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    ).drop("_before")
