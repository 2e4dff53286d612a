"""Cutting a table into ranges of a key, the same way on every run."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LEAST_BINS = 64
WIDE = "decimal(38,0)"  # differences of longs may not fit a long


def weighed_ranges(rows: DataFrame, key: str, weight: Column, target: int) -> tuple[list[int], list[int], int]:
    """Lower bounds of ranges of ``key`` (a long) that hold about ``target`` of ``weight`` each,
    what each holds, and what null keys weigh.

    Keys are counted in equal bins, some for each range to come; a bin that holds more
    than ``target`` is cut again. The driver gets a few numbers per range; choose
    ``target`` for the number of ranges it can hold. One key is never split: one of more
    than ``target`` is a range of its own.
    """
    keyed = rows.select(F.col(key).cast(WIDE).alias("k"), weight.alias("w"))
    weighed = keyed.where("k IS NOT NULL")
    low, high, total, nulls = keyed.agg(
        F.min("k"), F.max("k"), F.sum(F.when(F.col("k").isNotNull(), F.col("w"))), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("w"))), F.lit(0))).first()
    if low is None:
        return [], [], nulls
    sums, wide, todo, left = {}, int(high) - int(low) + 1, [low], total
    while todo:  # each round cuts the heavy bins, which are equally wide, into narrower ones
        parts = max(LEAST_BINS, -(-4 * left // (target * len(todo))))
        width = -(-wide // parts)
        outer = F.col("k") - F.pmod(F.col("k") - F.lit(low), F.lit(Decimal(wide)))
        inside = weighed.withColumn("o", outer.cast(WIDE))
        if sums:  # in the first round all keys are in the one bin; later there are fewer heavy bins than ranges
            heavy = weighed.sparkSession.createDataFrame([(x,) for x in todo], f"o {WIDE}")
            inside = inside.join(F.broadcast(heavy), "o", "left_semi")
        inner = F.col("k") - F.pmod(F.col("k") - F.col("o"), F.lit(Decimal(width)))
        found = {r["b"]: r["w"] for r in inside.groupBy(inner.cast(WIDE).alias("b")).agg(F.sum("w").alias("w")).collect()}
        todo = [b for b, w in found.items() if w > target and width > 1]
        left = sum(found[b] for b in todo)
        sums.update((int(b), w) for b, w in found.items())
        for b in todo:  # their parts come in the next round
            sums[int(b)] = 0
        wide = width
    cuts, held = [], []
    for b in sorted(b for b in sums if sums[b]):
        if not held or held[-1] + sums[b] > target:
            cuts.append(b)
            held.append(0)
        held[-1] += sums[b]
    return cuts, held, nulls


def range_cuts(rows: DataFrame, key: str, weight: Column, target: int) -> list[int]:
    """Lower bounds of ranges of ``key`` that hold about ``target`` of ``weight`` each."""
    return weighed_ranges(rows, key, weight, target)[0]


def range_number(key: Column, cuts: list[int]) -> Column:
    """The number of the range that a key is in; 0 for null and for what is below all ranges."""
    bounds = np.array(cuts[1:], np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    return number(F.coalesce(key, F.lit(-(2**63))))
