"""Exact top-k search by a Voronoi join on integer inner products."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from logprism.llm.clusters import grouped, spread_groups
from logprism.llm.prefix import prefix_sums
from logprism.llm.storage import stage

SCALE = 64
TOP = 20
PIVOTS = 64  # at least; of more than 270,000 rows, an eighth of the root of their number
GROUP_QUERIES = 4096
BLOCK_ROWS = 8192
CELLS = 1 << 21  # of a matrix that is held at a time
SLACK = 1e-6  # relative; bounds are widened by it against rounding


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the floor of ``scale`` times each component, of vectors without null or non-finite ones."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def _matrix(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """One row per vector; empty vectors are a single 0."""
    if not size:
        return np.zeros((len(vectors), 1), np.int64)
    flat = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) and vectors.num_chunks else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(vectors) else np.zeros((0, size), np.int64)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Cuts of ``rows`` rows so that a matrix of ``width`` columns stays small."""
    step = max(1, CELLS // max(1, width))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows of whole numbers; their squares are exact where they are below 2^53."""
    widest = float(np.abs(x).max(initial=0)) + float(np.abs(centres).max(initial=0))
    if widest**2 * x.shape[1] < 2.0**52:
        return np.sqrt((x**2).sum(1)[:, None] - 2 * (x @ centres.T) + (centres**2).sum(1))
    out = np.zeros((len(x), len(centres)))
    for part in _slices(len(x), centres.size):
        out[part] = np.sqrt(((x[part, None, :] - centres[None]) ** 2).sum(2))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact below 2^63 (beyond, they wrap around as longs do)."""
    size = a.shape[1]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * size < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best_rows(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the ``top`` highest scores, ties to smaller ids (ids are sorted)."""
    if scores.size > top:
        least = np.partition(scores, scores.size - top)[scores.size - top]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        at = np.concatenate((above, equal[:top - above.size]))
    else:
        at = np.arange(scores.size)
    return at[np.lexsort((ids[at], -scores[at]))]


def knn_join(vectors: DataFrame, is_query: Column, top: int = TOP, pivots: int = PIVOTS) -> DataFrame:
    """Per query its ``top`` rows of highest integer inner product: query_id, rank, vec_id, score.

    ``vectors`` holds vec_id and x (``quantised``). Only vectors of equal length are
    compared; a query's own id is no candidate. Ties go to smaller ids; fewer rows than
    ``top`` give fewer results. Repeated rows are candidates of their own, but a query
    is asked once per id and vector.

    The distinct vectors lowest in a hash, ``pivots`` or more as the rows grow, cut the
    data into cells. A cell is described by its radius and its ``top`` + 1 smallest
    distances. By the triangle inequality, a vector at distance r from pivot p scores
    between q.p - |q| r and q.p + |q| r. So the summaries bound the score of a query's
    last result from below, and thereby the distance from each pivot beyond which no
    vector can be a result. Queries are grouped by their cells; a group takes the loosest
    of its queries' distances, and only data within them are copied to it. A group is
    solved in chunks of at most ``GROUP_QUERIES`` queries against blocks of about
    ``BLOCK_ROWS`` rows, cut from the data within its bounds, and the blocks' best are
    ranked. Pivots, summaries and bounds (at most pivots x pivots) are small.
    """
    spark = vectors.sparkSession
    out = []
    rows = stage(vectors.withColumn("size", F.size("x")).withColumn("query", is_query), "knn-vectors")
    for size in sorted(r["size"] for r in rows.select("size").distinct().collect()):
        out.append(_join_equal(rows.where(F.col("size") == size).drop("size"), size, top, pivots))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = [F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pivots(rows: DataFrame, size: int, wanted: int) -> np.ndarray:
    """Distinct vectors, the ``wanted`` lowest in a hash. Only hashes are shuffled to find them."""
    hashed = rows.select(F.xxhash64("x").alias("h"), "x")
    lowest = hashed.select("h").distinct().orderBy("h").limit(wanted)
    found = hashed.join(F.broadcast(lowest), "h").groupBy("h").agg(F.min("x").alias("x"))
    return np.unique(_matrix(found.select("x").toArrow().column(0), size), axis=0).astype(float)


def _join_equal(rows: DataFrame, size: int, top: int, pivots: int) -> DataFrame:
    spark = rows.sparkSession
    centres = _pivots(rows, size, max(pivots, isqrt(rows.count()) // 8))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size).astype(float)
            cell, least = np.zeros(len(x), np.int32), np.zeros(len(x))
            for part in _slices(len(x), len(centres)):
                away = distances(x[part], centres)
                cell[part], least[part] = away.argmin(1), away.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(least)], ["vec_id", "x", "query", "cell", "away"])

    placed = stage(rows.select("vec_id", "x", "query").mapInArrow(assign, "vec_id long, x array<long>, query boolean, cell int, away double"), "knn-cells")
    near = placed.select("cell", "away", F.row_number().over(Window.partitionBy("cell").orderBy("away")).alias("k")).where(F.col("k") <= top + 1)
    closest = [[] for _ in range(len(centres))]
    for r in near.collect():  # at most pivots x (top + 1)
        closest[r["cell"]].append(r["away"])
    radius = np.zeros(len(centres))
    queries = np.zeros(len(centres), int)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.when(F.col("query"), 1)).alias("q")).collect():
        radius[r["cell"]], queries[r["cell"]] = r["r"], r["q"]
    known_cell = np.concatenate([np.full(len(x), i) for i, x in enumerate(closest)]).astype(int)
    known_away = np.concatenate([np.array(x) for x in closest])

    group_of = _group_cells(centres, queries)
    groups = int(group_of.max()) + 1
    group_table = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "cell int, grp long")
    asked = placed.where("query").join(F.broadcast(group_table), "cell").select("grp", "vec_id", "x").distinct()
    lots = max(1, -(-int(queries.sum()) // GROUP_QUERIES))
    asked = prefix_sums(
        asked.withColumn("lot", F.pmod(F.xxhash64("vec_id", "x"), F.lit(lots))).withColumn("one", F.lit(1).cast("long")),
        "grp", "lot", [F.col("vec_id"), F.xxhash64("x")], "one", "place")
    asked = stage(asked.select("grp", F.floor(F.col("place") / F.lit(GROUP_QUERIES)).cast("long").alias("chunk"), "vec_id", "x"), "knn-queries")
    chunks = np.zeros(groups, int)
    for r in asked.groupBy("grp").agg(F.max("chunk").alias("last")).collect():
        chunks[r["grp"]] = r["last"] + 1

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosest = np.full((groups, len(centres)), np.inf)
        for batch in batches:
            every, of = _matrix(batch.column(1), size).astype(float), batch.column(0).to_numpy()
            for part in _slices(len(every), known_cell.size):
                x, mine = every[part], of[part]
                length, to = np.sqrt((x**2).sum(1)), x @ centres.T
                least = to[:, known_cell] - length[:, None] * known_away
                if least.shape[1] > top:  # one more than asked, as a query's own row may be among them
                    bound = np.partition(least, least.shape[1] - top - 1, axis=1)[:, least.shape[1] - top - 1]
                else:
                    bound = np.full(len(x), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = (bound[:, None] - to) / length[:, None]
                far = np.where(length[:, None] > 0, far, -np.inf)  # a vector must be at least so far from the pivot
                for g in np.unique(mine):
                    loosest[g] = np.minimum(loosest[g], far[mine == g].min(0))
        grp, cell = np.nonzero(loosest <= radius * (1 + SLACK) + SLACK)
        yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(cell), pa.array(loosest[grp, cell])], ["grp", "cell", "least"])

    bounds = asked.select("grp", "x").mapInArrow(reach, "grp long, cell long, least double").groupBy("grp", "cell").agg(F.min("least").alias("least"))
    floor = np.full((groups, len(centres)), np.inf)
    table = bounds.toArrow()  # at most groups x pivots rows
    floor[table.column("grp").to_numpy(), table.column("cell").to_numpy()] = table.column("least").to_numpy() * (1 - SLACK) - SLACK

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(groups, np.int64)
        for batch in batches:
            cell, away = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(cell):
                held += (cell == c).sum() - np.searchsorted(np.sort(away[cell == c]), floor[:, c])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), pa.array(held)], ["grp", "n"])

    blocks = np.zeros(groups, int)
    for r in placed.select("cell", "away").mapInArrow(reached, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():
        blocks[r["grp"]] = -(-r["n"] // BLOCK_ROWS)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.full(groups, TaskContext.get().partitionId() * 7919)  # a group's rows go to its blocks in turn
        for batch in batches:
            cell, away = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for part in _slices(batch.num_rows, int(chunks.sum())):
                grp, row = np.nonzero(away[part][None] >= floor[:, cell[part]])
                counts = np.bincount(grp, minlength=groups)
                starts = np.cumsum(counts) - counts
                block = (turn[grp] + np.arange(grp.size) - starts[grp]) % blocks[grp]
                turn += counts
                times = chunks[grp]
                pair = np.repeat(np.arange(grp.size), times)
                chunk = np.arange(pair.size) - np.repeat(np.cumsum(times) - times, times)
                for i in range(0, pair.size, BLOCK_ROWS):
                    at = pair[i:i + BLOCK_ROWS]
                    taken = pa.array(row[at] + part.start)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(grp[at]), pa.array(chunk[i:i + BLOCK_ROWS]), pa.array(block[at]), pa.array(np.zeros(at.size, np.int32)),
                        batch.column(0).take(taken), batch.column(1).take(taken)], ["grp", "chunk", "block", "asks", "vec_id", "x"])

    data = placed.select("vec_id", "x", "cell", "away").mapInArrow(
        copied, "grp long, chunk long, block long, asks int, vec_id long, x array<long>")
    block_table = spark.createDataFrame([(g, int(n)) for g, n in enumerate(blocks) if n], "grp long, blocks long")
    asked = asked.join(F.broadcast(block_table), "grp").select(
        "grp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "vec_id", "x")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            asks, ids = table.column("asks").to_numpy() > 0, table.column("vec_id").to_numpy()
            x = _matrix(table.column("x"), size)
            order = np.argsort(ids[~asks], kind="stable")
            data_ids, data_x = ids[~asks][order], x[~asks][order]
            if not data_ids.size:
                continue
            for start in range(0, int(asks.sum()), 256):
                part = slice(start, start + 256)
                names = ids[asks][part]
                parts = [[], [], []]
                for name, scores in zip(names, products(x[asks][part], data_x), strict=True):
                    other = data_ids != name
                    at = best_rows(scores[other], data_ids[other], top)
                    for held, values in zip(parts, (np.full(at.size, name), data_ids[other][at], scores[other][at]), strict=True):
                        held.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["query_id", "vec_id", "score"])

    return spread_groups(data.unionByName(asked), ["grp", "chunk", "block"]).mapInArrow(solve, "query_id long, vec_id long, score long")


def _group_cells(centres: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cells joined to groups of up to ``GROUP_QUERIES`` queries, each taking the cell nearest to its
    first. A cell of more is a group of its own, of which chunks are cut."""
    group_of, left, no = np.zeros(len(centres), int), set(range(len(centres))), 0
    while left:
        first = max(left, key=lambda i: (queries[i], -i))
        rest = np.array(sorted(left))
        near = rest[np.argsort(distances(centres[first:first + 1], centres[rest])[0], kind="stable")].tolist()
        held = 0
        for i in near:
            if held and held + queries[i] > GROUP_QUERIES:
                break
            group_of[i], held = no, held + queries[i]
            left.discard(i)
        no += 1
    return group_of


def knn_report(vectors: DataFrame) -> DataFrame:
    """The 20 best rows of every vector whose id is divisible by 20."""
    return knn_join(quantised(vectors), F.col("vec_id") % 20 == 0)


KNN_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x::DOUBLE[], d.x::DOUBLE[])::BIGINT AS score
 FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
