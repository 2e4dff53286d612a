"""Groups compared in tasks: streaming groups of rows, cutting large ones into pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of neighbouring rows that are equal in the first ``keys`` columns (longs, no nulls)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        change = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(columns[:, start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold whole groups, and the bounds of the groups in them."""
    held, sizes, total = [], [], 0
    for group in grouped(batches, keys):
        held.append(group)
        sizes.append(group.num_rows)
        total += group.num_rows
        if total >= rows:
            yield pa.concat_tables(held), np.cumsum([0, *sizes])
            held, sizes, total = [], [], 0
    if held:
        yield pa.concat_tables(held), np.cumsum([0, *sizes])


def groups_with_links(bounds: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], large: int = 64) -> list[int]:
    """Groups of which some pair of rows may link: all that have more than ``large`` rows, and the
    smaller ones where ``linked(rows, others)`` is true of a pair. All small groups are tried at once."""
    sizes = np.diff(bounds)
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    left = np.repeat(np.where(sizes <= large, sizes, 0), sizes) - place - 1  # rows behind in a small group
    found = sizes > large
    owner = np.repeat(np.arange(sizes.size), sizes)
    for step in range(1, int(sizes[~found].max(initial=0))):
        rows = np.flatnonzero((left >= step) & ~found[owner])
        found[owner[rows[linked(rows, rows + step)]]] = True
    return np.flatnonzero(found).tolist()


def block_pairs(rows: DataFrame, group: str, member: Column, count: Column, block: int) -> DataFrame:
    """Adds longs ``low`` and ``high``: the pairs of blocks of its group that a row belongs to.

    A group of up to ``block`` rows stays together. A larger one is cut into blocks by
    hash, and each pair of blocks becomes a task's group, so that all pairs of rows meet
    but no task gets more than about two blocks.
    """
    blocks = F.ceil(count / F.lit(block))
    own = F.pmod(F.xxhash64(member, F.lit(block)), blocks)
    cut = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return cut.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other")).drop("_own", "_other")


def spread_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group together and next to each other; the keys come first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys)


def spanning_links(n: int, linked: Callable[[int, np.ndarray], np.ndarray], reached: Sequence[int] = ()) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected: each row is only compared with rows not yet reached.

    ``linked(i, others)`` tells which of the others link with i. Where a group is alike,
    the first comparisons reach nearly all of it. The rows in ``reached`` are connected already.
    """
    left = np.setdiff1d(np.arange(n), np.asarray(reached, int))
    queue = [int(i) for i in reached]
    while left.size > (not queue):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            i = queue.pop()
            hit = linked(i, left)
            for j in left[hit]:
                yield i, int(j)
                queue.append(int(j))
            left = left[~hit]
