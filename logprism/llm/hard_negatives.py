"""Hard negatives of anchors by Fagin's threshold algorithm on integer inner products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logprism.llm.knn import products
from logprism.llm.storage import release_memory, stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST, MOST = 80, 100  # a negative's score as a share of its positive's, in hundredths
BLOCK_ROWS = 16384
FIRST_DEPTH = 8  # entries read from each list at first; then twice as many each time
COLUMNS = "vec_id long, label long, x array<long>"


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (floors of ``scale`` times the components) of rows without null or non-finite parts."""
    finite = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"))


class Lists:
    """A block's rows, and for every dimension its rows sorted by that component."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.x, self.ids, self.labels = x, ids, labels
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(x.T, self.order, 1)

    def heads(self, anchors: np.ndarray) -> np.ndarray:
        """The threshold of each anchor before anything is read: no row scores more."""
        return products(np.maximum(anchors, 0), self.sorted[:, -1][None]).ravel() + products(np.minimum(anchors, 0), self.sorted[:, 0][None]).ravel()


def threshold_search(lists: Lists, anchor: np.ndarray, fits: Callable[[np.ndarray], np.ndarray],
                     done: Callable[[np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of all rows met until ``done(scores so far, threshold)``, and how many were met.

    The lists are read side by side: from their upper ends where the anchor's component is
    positive, from their lower ends where it is negative, not at all where it is 0. A row
    met for the first time is looked up and scored whole, if ``fits(rows)``. The threshold
    is the anchor's product with the entries reached in the lists: no row that has not been
    met scores more. Ties with it may still be unmet, so callers compare strictly.
    """
    n = len(lists.x)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    met = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        end = min(n, depth + step) if up.size + down.size else n
        read = np.zeros(n, bool)
        if up.size + down.size:
            read[lists.order[up, n - end:n - depth]] = True
            read[lists.order[down, depth:end]] = True
        else:
            read[:] = True
        fresh = np.flatnonzero(read & ~met)
        met[fresh] = True
        fresh = fresh[fits(fresh)]
        rows = np.concatenate((rows, fresh))
        scores = np.concatenate((scores, products(lists.x[fresh], anchor[None]).ravel()))
        edge = products(anchor[up][None], lists.sorted[up, n - end][None]) + products(anchor[down][None], lists.sorted[down, end - 1][None])
        if end < n and done(scores, int(edge[0, 0])):
            break
        depth, step = end, 2 * step
    return rows, scores, int(met.sum())


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.zeros((len(vectors), 1), np.int64)


def _solve(rows: DataFrame, asks: DataFrame, keys: list[str], need: str, schema: str,
           answer: Callable[[Lists, dict[str, np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """Rows of ``rows`` and ``asks`` that are equal in ``keys`` (longs) meet in a task: blocks first, then the asks that stream past.

    ``need`` are the columns that only asks have.
    """
    names = [c.split()[0] for c in need.split(", ")]
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in need.split(", ")]
    keyed = [F.col(k).alias(f"_{k}") for k in keys]
    keys = [f"_{k}" for k in keys]
    every = rows.select(*keyed, F.lit(0).alias("ask"), "vec_id", "label", "x", *blank).unionByName(
        asks.select(*keyed, F.lit(1).alias("ask"), "vec_id", "label", "x", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, lists = None, [], None
        for batch in batches:
            columns = np.stack([batch.column(c).to_numpy() for c in [*keys, "ask"]])
            edges = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                key, part = tuple(columns[:-1, start]), batch.slice(start, end - start)
                if key != last:
                    last, held, lists = key, [], None
                if not columns[-1, start]:
                    held.append(part)
                    continue
                if not held and lists is None:
                    continue
                size = len(part.column("x")[0])
                if lists is None:
                    x = np.concatenate([_matrix(p.column("x"), size) for p in held])
                    ids, labels = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("vec_id", "label"))
                    lists, held = Lists(x, ids, labels), []
                asked = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", *names)}
                yield answer(lists, {**asked, "x": _matrix(part.column("x"), size)})
        release_memory()

    return every.repartition(*keys).sortWithinPartitions(*keys, "ask").mapInArrow(run, schema)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by`` how many blocks of about ``BLOCK_ROWS`` rows it is cut into."""
    return rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("blocks"))


def positives(rows: DataFrame, anchors: DataFrame, count: int = POSITIVES) -> DataFrame:
    """Per anchor the ``count`` rows of its label with the highest scores: anchor, place, positive_id, positive_score."""
    by = ["size", "label"]
    sizes = _blocks(rows, by)
    placed = rows.join(sizes, by).withColumn("block", F.pmod("salt", "blocks"))
    asked = anchors.join(sizes, by).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def answer(lists: Lists, asked: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = [[], [], []]
        for anchor, name, x in zip(asked["anchor"], asked["vec_id"], asked["x"], strict=True):
            other = lists.ids != name

            def done(scores: np.ndarray, edge: int) -> bool:
                return np.count_nonzero(scores > edge) >= count

            at, scores, _ = threshold_search(lists, x, lambda r: other[r], done)  # noqa: B023
            best = np.lexsort((lists.ids[at], -scores))[:count]
            for held, values in zip(out, (np.full(best.size, anchor), lists.ids[at][best], scores[best]), strict=True):
                held.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in out], ["anchor", "positive_id", "positive_score"])

    found = _solve(placed, asked, [*by, "block"], "anchor long", "anchor long, positive_id long, positive_score long", answer)
    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= count)


def negatives(rows: DataFrame, anchors: DataFrame, count: int = NEGATIVES) -> DataFrame:
    """Per anchor and window the ``count`` rows of other labels with the highest scores in it.

    ``anchors`` holds the positives' scores as an array, by place. Gives anchor, place, rank,
    negative_id, negative_score.
    """
    by = ["size"]
    sizes = _blocks(rows, by)
    placed = rows.join(F.broadcast(sizes), by).withColumn("block", F.pmod("salt", "blocks"))  # a row per length of vectors
    asked = anchors.join(F.broadcast(sizes), by).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def answer(lists: Lists, asked: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = [[], [], [], []]
        heads = lists.heads(asked["x"])
        for anchor, label, x, highs, head in zip(asked["anchor"], asked["label"], asked["x"], asked["highs"], heads, strict=True):
            high = np.asarray(highs, np.int64)
            low = -(-LEAST * high // MOST)  # the least whole score of the window
            if head < low[low <= high].min(initial=2**62):
                continue
            other = lists.labels != label

            def done(scores: np.ndarray, edge: int) -> bool:
                ordered = np.sort(scores)
                inside = np.searchsorted(ordered, high, side="right") - np.searchsorted(ordered, np.maximum(low, edge + 1))  # noqa: B023
                return bool(((inside >= count) | (low > edge) | (low > high)).all())  # noqa: B023

            at, scores, _ = threshold_search(lists, x, lambda r: other[r], done)  # noqa: B023
            order = np.lexsort((lists.ids[at], -scores))
            ids, falling = lists.ids[at][order], -scores[order]
            for place, (a, b) in enumerate(zip(low, high, strict=True), 1):
                part = slice(np.searchsorted(falling, -b), min(np.searchsorted(falling, -b) + count, np.searchsorted(falling, -a, side="right")))
                found = ids[part]
                for held, values in zip(out, (np.full(found.size, anchor), np.full(found.size, place), found, -falling[part]), strict=True):
                    held.append(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for v in out], ["anchor", "place", "negative_id", "negative_score"])

    found = _solve(placed, asked, [*by, "block"], "anchor long, highs array<bigint>", "anchor long, place long, negative_id long, negative_score long", answer)
    best = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` holds vec_id, label and x (:func:`usable`). An anchor's positives are the five
    rows of its label and of another id that score highest with it. For each, its negatives
    are the five rows of other labels that score highest among those whose score is 80 to
    100 % of the positive's; so a positive that scores below 0 has none. Ties go to smaller
    ids. Only vectors of equal length are compared. Repeated rows are rows of their own, as
    positives and as negatives; an anchor is asked once per id, label and vector.

    Rows are cut into blocks by a stored random number, so that a hot label or vector fills
    many blocks; a block is sorted once per dimension, and the anchors stream past it. Each
    block gives an anchor's best there by the threshold algorithm, and the blocks' best are
    ranked. Anchors are copied to every block of their label, then to every block of all
    rows. An anchor whose first threshold is below its windows costs a block two products.
    """
    salted = rows.withColumn("size", F.size("x").cast("long")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = stage(salted, "negatives-rows")  # written, as the random numbers must stay
    asked = rows.where(is_anchor).select("vec_id", "label", "x", "size").distinct()
    anchors = stage(asked.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    found = stage(positives(rows, anchors), "negatives-positives")
    windows = found.groupBy("anchor").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("highs"))  # at most five
    mined = negatives(rows, anchors.join(windows, "anchor"))
    return mined.join(found, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def negatives_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, labels of every seventh id moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(vectors, moved), F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
a AS (SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)),
s AS (SELECT anchor, a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, list_inner_product(a.x::DOUBLE[], v.x::DOUBLE[])::BIGINT AS score
 FROM a JOIN v ON len(a.x) = len(v.x)),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
 FROM s WHERE same AND vec_id <> anchor_id QUALIFY place <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor, place ORDER BY score DESC, s.vec_id)::INT AS rank
 FROM p JOIN s USING (anchor) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
