"""Near duplicates among embeddings: cross-polytope hashes, multiprobe buckets, verified links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logprism.llm.clusters import block_pairs, grouped, groups_with_links, spanning_links, spread_groups, whole_groups
from logprism.llm.components import components
from logprism.llm.storage import stage

COSINE = 0.93
TABLES = 6
HASHES = 2  # rotations whose cross-polytope vertices make up a bucket
PROBES = 4  # buckets per table
NEAREST = 3  # vertices of a rotation that probes choose from
BLOCK = 2048
PAIR = "a long, b long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


@cache
def signs(size: int, table: int, number: int) -> np.ndarray:
    """Three diagonals of random signs."""
    return np.random.default_rng([size, table, number]).choice([-1.0, 1.0], (3, size))


def buckets(vectors: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """``PROBES`` buckets per table of unit vectors: rows x (tables * probes) of hashes.

    A rotation is three rounds of random signs and a Hadamard transform. The nearest
    vertex of the cross-polytope is the largest coordinate with its sign; probes take
    the combinations of near vertices that lose least.
    """
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), size))
    padded[:, :vectors.shape[1]] = vectors
    some = min(NEAREST, size)
    combos = np.array(list(product(range(some), repeat=HASHES)))
    out = []
    for table in range(tables):
        vertices, losses = [], []
        for number in range(HASHES):
            y = padded
            for diagonal in signs(size, table, number):
                y = hadamard(y * diagonal)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :some]
            value = np.take_along_axis(y, near, 1)
            vertices.append(2 * near + (value < 0))
            losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        loss = sum(losses[k][:, combos[:, k]] for k in range(HASHES))
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        key = np.full(best.shape, table, np.int64)
        for k in range(HASHES):
            key = key * (2 * size) + np.take_along_axis(vertices[k], combos[best, k], 1)
        out.append(key)
    return np.concatenate(out, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    values = np.array(column.to_pylist(), np.float64)
    largest = np.abs(values).max(1, keepdims=True)
    values = values / largest  # so that squares stay in range
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _can_link() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, size, and two hashes of the vector, of rows that can link."""
    rows = vectors.where(_can_link()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.select("*", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))


def near_embeddings(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """Links of vectors with equal label and cosine of at least ``cosine``, per vec_id of a class.

    Equal vectors form a class, named by its least vec_id. Returns ``usable`` rows'
    classes: label, size, h1, h2, rep, n (rows), n_links (rows linked with each row), component.

    Classes meet in buckets; within a bucket, links that connect it are found. Links are
    then counted exactly within the components, so copies and dense groups are never
    written out as pairs, and a link that no bucket showed counts if its ends are
    connected otherwise. Large buckets and components are cut into pairs of blocks.
    """
    rows = usable(vectors)
    classes = stage(rows.groupBy("label", "size", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding")), "vector-classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                keys = buckets(_matrix(part.column(2)), tables)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], ["rep", "key"])

    keys = classes.select("rep", "size", "embedding").mapInArrow(hashed, "rep long, key long")
    keys = stage(keys.join(classes.select("rep", F.xxhash64("label", "size").alias("kind")), "rep").select(
        "rep", F.xxhash64("key", "kind").alias("bucket")).distinct(), "vector-buckets")
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = keys.join(shared, "bucket").join(classes.select("rep", F.xxhash64("label", "size").alias("kind"), "embedding"), "rep")
    cut = block_pairs(members, "bucket", F.col("rep"), F.col("members"), BLOCK)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 3):
            reps, kinds, links = table.column("rep").to_numpy(), table.column("kind").to_numpy(), []
            size = np.array([len(x) for x in table.column("embedding").to_pylist()])
            unit = np.zeros((len(size), size.max()))
            for n in np.unique(size):
                unit[size == n, :n] = _matrix(table.column("embedding").filter(pa.array(size == n)))

            def near(i: np.ndarray | int, others: np.ndarray) -> np.ndarray:
                """Labels and lengths may differ in a bucket, by accident of its hash."""
                return (kinds[i] == kinds[others]) & (np.einsum("...j,...j", unit[i], unit[others]) >= cosine)  # noqa: B023

            for g in groups_with_links(bounds, near):
                rows = np.arange(bounds[g], bounds[g + 1])
                links += [(reps[rows[i]], reps[rows[j]]) for i, j in spanning_links(rows.size, lambda i, others: near(rows[i], rows[others]))]  # noqa: B023
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    links = spread_groups(cut.select("bucket", "low", "high", "rep", "kind", "embedding"), ["bucket", "low", "high"]).mapInArrow(connect, PAIR)
    found = stage(components(links), "vector-components")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    within = found.join(sizes, "component").join(classes.select(F.col("rep").alias("id"), "n", "embedding"), "id")
    cut = block_pairs(within, "component", F.col("id"), F.col("members"), BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
            own, ids, n = (group.column(c).to_numpy() for c in ("own", "id", "n"))
            unit = _matrix(group.column("embedding"))
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if low != high:  # pairs within a block are counted with low == high
                near &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ n)], ["id", "links"])

    cut = cut.withColumn("own", F.pmod(F.xxhash64("id", F.lit(BLOCK)), F.ceil(F.col("members") / F.lit(BLOCK))))
    counted = spread_groups(cut.select("component", "low", "high", "own", "id", "n", "embedding"), ["component", "low", "high"]).mapInArrow(
        count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    return classes.drop("embedding").join(found.join(counted, "id", "left").withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "size", "h1", "h2", "rep", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))


def embedding_report(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Rows without a label or a usable vector link with nothing and are their own
    component; rows without an id too, and are kept. Rows that repeat a vec_id count as
    vectors of their own.
    """
    classes = near_embeddings(vectors)
    linked = usable(vectors).drop("embedding").join(classes, ["label", "size", "h1", "h2"]).select("vec_id", "n_links", "component")
    own_id = F.col("vec_id").cast("long")
    alone = vectors.where(~_can_link()).select(own_id.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own_id.alias("component"))
    return linked.unionByName(alone).select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
 AND list_bool_or([x <> 0 FOR x IN embedding])),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
 AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id"""
