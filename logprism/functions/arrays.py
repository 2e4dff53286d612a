"""Helpers that aggregate inside one row's array, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def count_where(items: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, predicate)).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def runs(items: Column, key: Callable[[Column], Column]) -> Column:
    """Cut an array already sorted by ``key`` into one array per key value.

    This is a GROUP BY within a row: linear in the array's length.
    """
    positions = F.sequence(F.lit(0), F.size(items) - 1)
    starts = F.filter(
        F.when(F.size(items) > 0, positions).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1))),
    )
    bounds = F.transform(
        starts,
        lambda s, n: F.struct(
            s.alias("start"), F.coalesce(F.get(starts, n + 1), F.size(items)).alias("stop")
        ),
    )
    return F.transform(bounds, lambda b: F.slice(items, b.start + 1, b.stop - b.start))
