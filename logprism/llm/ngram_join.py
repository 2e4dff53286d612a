"""Near duplicates by Jaccard similarity of word 5-grams: chosen-path join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logprism.llm.clusters import block_pairs, grouped, groups_with_links, spanning_links, spread_groups, whole_groups
from logprism.llm.components import components
from logprism.llm.storage import release_memory, stage

WORDS = 5
SIMILARITY = 0.8
MISS = 1e-5  # chance of missing a pair of just that similarity that is allowed
DEPTH = 3  # levels of a tree; what is large at the last is compared in full
SMALL = 256  # sets in a node that are compared without splitting it further
PART = 64  # sets of a larger node that are compared before it is split
SKETCH = 64
SKETCH_LEAST = 0.575  # 0.8 less 4.5 standard deviations of the estimate from a sketch
BLOCK = 2048  # sketches
SET_BLOCK = 256
CELLS = 1 << 24  # of a block of the incidence matrix
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
WORD_MIX, GRAM_MIX, PATH_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
LOTS = 1 << 18  # bytes of text worked on at a time
PAIR = "a long, b long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * WORD_MIX
    x = (x ^ (x >> np.uint64(29))) * GRAM_MIX
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            n = 1 << n.bit_length()
            steps = [np.full(n, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
            for step in steps:
                step[0] = 1
            self.up, self.down = (np.cumprod(step, dtype=np.uint64) for step in steps)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 text, and where they start."""
    signs = np.frombuffer(data, np.uint8)
    space = SPACES[signs]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = POWERS.get(signs.size + 1)
    sums = np.zeros(signs.size + 1, np.uint64)
    np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[:signs.size], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def gram_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's word 5-grams; of all its words if there are fewer; none without words."""
    at = 0
    while at < len(texts):
        lot, sizes, size = [], [], 0
        while at < len(texts) and (not lot or size < LOTS):
            data = (texts[at] or "").encode("utf-8", "surrogatepass")
            lot.append(data)
            sizes.append(len(data) + 1)
            size += len(data)
            at += 1
        hashes, starts = word_hashes(b"\n".join(lot))
        bounds = np.searchsorted(starts, np.cumsum([0, *sizes]))
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            words = hashes[first:last]
            n = min(WORDS, words.size)
            if not n:
                yield words
                continue
            grams = np.zeros(words.size - n + 1, np.uint64)
            for i in range(n):
                grams = grams * GRAM_MIX + words[i:i + grams.size]
            yield np.unique(mix(grams))


def runs_needed(level: int) -> int:
    """Runs after which two sets of just that similarity have shared no node at a level with a chance of ``MISS``.

    They share at least one child of a shared node on average, so the chance that a run
    has lost them by a level follows from that of the level above.
    """
    lost = 0.0
    for _ in range(level):
        lost = exp(lost - 1)
    return ceil(log(MISS) / log(lost))


def paths(tokens: np.ndarray, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of a set in the trees of runs ``first`` to ``last``: by level, (parents, nodes).

    Below a node, the set goes to the child of every token whose hash at that node is
    under 1 / (similarity * size); a set thus has 1 / similarity children on average, and
    two sets share the more of them the more similar they are.
    """
    share = SIMILARITY * tokens.size
    most = np.uint64(min(2.0**64 / share, 2.0**64 - 4096)) if share > 1 else None
    nodes, out = mix(np.arange(first + 1, last + 1, dtype=np.uint64)), []
    for _ in range(DEPTH):
        parents, children = [], []
        for part in np.array_split(nodes, max(1, nodes.size * tokens.size >> 20)):
            drawn = mix(tokens[None, :] ^ (part[:, None] * PATH_MIX)) if most is not None else np.zeros((part.size, tokens.size), np.uint64)
            row, column = np.nonzero(drawn < most) if most is not None else np.nonzero(drawn == 0)
            parents.append(part[row])
            children.append(mix(part[row] * GRAM_MIX + tokens[column]))
        parents, nodes = np.concatenate(parents), np.concatenate(children)
        out.append((parents, nodes))
    return out


LEVELS = [f"{x}{k}" for k in range(DEPTH) for x in ("parents", "nodes")]


def described(rows: DataFrame, first: int, last: int) -> DataFrame:
    """``rows`` without their text, with their sets' key, sketch, and nodes by level in the given runs.

    A text without words has null for all of them. The sketch is the 64 least hashes of
    the set: of small sets, the whole set.
    """
    names = [c for c in rows.columns if c != "text"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for start in range(0, len(texts), 500):
                columns = [[] for _ in range(2 + len(LEVELS))]
                for tokens in gram_sets(texts[start:start + 500]):
                    values = [None] * len(columns)
                    if tokens.size:
                        levels = [x.view(np.int64) for level in paths(tokens, first, last) for x in level]
                        values = [xxhash.xxh3_128_digest(tokens.tobytes()), tokens[:SKETCH].tobytes(), *levels]
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                kinds = [pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * len(LEVELS)]
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(start, 500).columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*names, "key", "sketch", *LEVELS])
        release_memory()

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names, "text").mapInArrow(describe, f"{own}, key binary, sketch binary, " + ", ".join(f"{c} array<long>" for c in LEVELS))


class Sketches:
    """Sketches of sets, and which of them look similar enough."""

    NONE = np.uint64(2**64 - 1)
    PAIRS = 4096  # compared at a time

    def __init__(self, sketches: list[bytes]) -> None:
        self.full = np.full((len(sketches), SKETCH), self.NONE)
        self.sizes = np.array([len(s) // 8 for s in sketches])
        for row, s in zip(self.full, sketches, strict=True):
            row[:len(s) // 8] = np.frombuffer(s, np.uint64)

    def alike(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Of the least hashes of each union, the share in both is the estimate."""
        out = [self._alike(rows[i:i + self.PAIRS], others[i:i + self.PAIRS]) for i in range(0, others.size, self.PAIRS)]
        return np.concatenate(out) if out else np.zeros(0, bool)

    def _alike(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        both = np.sort(np.concatenate((self.full[rows], self.full[others]), 1), 1)
        real = both != self.NONE
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        number = np.cumsum(~twice & real, 1)  # of the union's members, by size
        whole = (self.sizes[rows] < SKETCH) & (self.sizes[others] < SKETCH)
        k = np.where(whole, number[:, -1], np.minimum(number[:, -1], SKETCH))
        return (twice & (number <= k[:, None])).sum(1) >= SKETCH_LEAST * k


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least 0.8."""
    sizes = np.array([s.size for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    columns, column = np.unique(column[shared], return_inverse=True)
    owner, common = owner[shared], np.zeros((len(sets), len(sets)))
    step = max(1, CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, columns.size, step):
        part = slice(*np.searchsorted(column, (first, first + step)))
        held = np.zeros((len(sets), min(step, columns.size - first)), np.float32)
        held[owner[part], column[part] - first] = 1
        common += held @ held.T
    np.fill_diagonal(common, sizes)
    return common / (sizes[:, None] + sizes[None, :] - common) >= SIMILARITY


def _level(described: DataFrame, k: int) -> DataFrame:
    pair = F.arrays_zip(F.col(f"parents{k}").alias("p"), F.col(f"nodes{k}").alias("n"))
    return described.select("rep", F.explode(pair).alias("x")).select("rep", F.col("x.p").alias("parent"), F.col("x.n").alias("node")).distinct()


def _alike(rows: DataFrame) -> DataFrame:
    """Links a, b that connect what looks similar among rows (node, rep, sketch) that are equal in node, low and high.

    Rows that are ``top`` are connected already and are not compared with each other.
    """

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 3):
            reps, sketches, links = table.column("rep").to_numpy(), Sketches(table.column("sketch").to_pylist()), []
            top = table.column("top").to_numpy()
            for g in groups_with_links(bounds, sketches.alike):
                rows = np.arange(bounds[g], bounds[g + 1])
                near = spanning_links(rows.size, lambda i, others: sketches.alike(np.full(others.size, rows[i]), rows[others]), np.flatnonzero(top[rows]))  # noqa: B023
                links += [(reps[rows[i]], reps[rows[j]]) for i, j in near]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return spread_groups(rows.select("node", "low", "high", "rep", "sketch", "top"), ["node", "low", "high"]).mapInArrow(connect, PAIR)


def _parts(rows: DataFrame) -> DataFrame:
    """node, rep, low, high, top: rows (node, rep, members) in parts of about ``PART`` sets of a node, each row in one.

    The hash differs from node to node, so that sets which share many nodes meet in some part.
    """
    part = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("members") / F.lit(PART)))
    return rows.select("node", "rep", part.alias("low"), part.alias("high"), F.lit(False).alias("top"))


def _largest(own: DataFrame) -> DataFrame:
    """node, members, top, pairs_left of rows (node, rep, c): the largest component of each node, and how many pairs of
    its sets are in different components."""
    sizes = own.groupBy("node", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("node")
    sums = sizes.agg(F.sum("m").alias("members"), F.max_by("c", "m").alias("top"), F.sum(F.col("m") * F.col("m")).alias("within"))
    return sums.select("node", "members", "top", F.expr("(members * members - within) div 2").alias("pairs_left"))


def _rest(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, rep, low, high, top: the largest component of each of ``nodes`` in blocks, the other sets in every block."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK))
    block = F.pmod(F.xxhash64("rep", F.lit(BLOCK)), blocks)
    rows = own.join(nodes, "node").select("node", "rep", "members", (F.col("c") == F.col("top")).alias("top"))
    every = F.when(F.col("top"), F.array(block)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    return rows.select("node", "rep", F.explode(every).alias("low"), "top").select("node", "rep", "low", F.col("low").alias("high"), "top")


def _members(sets: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """node, rep, low, high, top, sketch of what to compare; the sets that went below the first level; links a, b found
    on the way, and the components that sets are known to be in.

    Level by level, nodes of two to ``SMALL`` sets are compared. In larger ones, links within
    parts of the nodes of the first level (or ``known``, if given) tell which sets are connected;
    where that leaves at most ``SMALL`` pairs for each set, those pairs are compared, and where it
    leaves none, nothing. The sets of other large nodes go on to their children. What is left
    at the last level is compared in full, cut into pairs of blocks.
    """
    found, large, deep, links = None, None, None, None
    for k in range(DEPTH):
        level = _level(sets, k)
        if large is not None:
            level = level.join(large.select(F.col("node").alias("parent")), "parent", "left_semi")
        level = stage(level.select("node", "rep"), "path-nodes")
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        here = [block_pairs(level.join(counts.where(F.col("members") <= SMALL), "node"), "node", F.col("rep"), F.col("members"), BLOCK)]
        many = stage(counts.where(F.col("members") > SMALL), "many-sets")
        some = not many.isEmpty()
        if some:
            many = stage(level.join(many, "node"), "many-rows")
            if known is None:
                links = stage(_alike(_parts(many).join(sets.select("rep", "sketch"), "rep")), "part-links")
                known = stage(components(links), "part-components")
            own = many.join(known, many["rep"] == known["id"], "left").select("node", "rep", F.coalesce("component", "rep").alias("c"))
            nodes = stage(_largest(own), "large-nodes")
            few = F.col("pairs_left") <= F.col("members") * F.lit(SMALL)
            here.append(_rest(own, nodes.where(few & F.expr("pairs_left > 0"))))
            large = nodes.where(~few).select("node")
            if k == DEPTH - 1:
                here.append(block_pairs(many.join(large, "node", "left_semi"), "node", F.col("rep"), F.col("members"), BLOCK))
        if k == 0:
            deep = stage(many.join(large, "node", "left_semi").select("rep").distinct() if some else level.select("rep").limit(0), "deep-sets")
        for rows in here:
            rows = rows if "top" in rows.columns else rows.withColumn("top", F.lit(False))
            rows = rows.select("node", "rep", "low", "high", "top")
            found = rows if found is None else found.unionByName(rows)
        if not some or large.isEmpty():
            break
    found = found.join(sets.select("rep", "sketch"), "rep")
    return found, deep, links, known


def candidates(sets: DataFrame, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links a, b between sets (rep, sketch, nodes by level) that look similar, connecting what may be linked.

    Sets that meet in large nodes are split further, and with each level a run is likelier
    to lose a pair. ``again(reps)`` gives such sets with their nodes in more runs, as many
    as bring the chance down to that of sets in small nodes.
    """
    found, deep, links, known = _members(sets)
    if not deep.isEmpty():
        found = found.unionByName(_members(stage(again(deep), "further-runs"), known)[0])
    near = _alike(found)
    return near if links is None else near.unionByName(links)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), text: what tells rows apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("h"), "text")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, h, times, rep, ...) with the text: one row each, also where ``docs`` has it ``times`` times."""
    rows = _keyed(docs)
    found = rows.join(wanted, _same(rows, wanted)).select(*[wanted[c] for c in wanted.columns], "text")
    return found.where("times = 1").unionByName(found.where("times > 1").dropDuplicates(["rep"])).drop("doc_id", "h", "times")


def near_documents(docs: DataFrame, counts: bool = True) -> DataFrame:
    """doc_id, h, component of every row of ``docs``, and its n_links if ``counts``.

    Every row is a document; an id need not be unique, nor known. Rows with equal sets of
    word 5-grams are one class. The chosen-path join gives candidate links between classes;
    what they connect is compared with whole sets, in blocks, and links of similarity 0.8
    or more connect (and are counted) there. So copies and dense groups are never written
    out as pairs. ``n_links`` counts documents; ``component`` is a number, null for a
    document without words; ``h`` is a hash of the text.
    """
    every = stage(described(_keyed(docs), 0, runs_needed(1)).withColumn("row", F.monotonically_increasing_id()), "gram-sets")
    reps = every.where("key IS NOT NULL").groupBy("key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stage(every.select("row", "doc_id", "h", "key").join(reps, "key", "left"), "gram-classes").drop("key")
    own = classes.where("row = rep").select("rep", "n", "doc_id", "h")
    repeated = classes.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    own = own.join(repeated, _same(own, repeated), "left").select("rep", "n", own["doc_id"], own["h"], F.coalesce("times", F.lit(1)).alias("times"))
    own = stage(own, "gram-texts")  # where each class has its text
    sets = every.select(F.col("row").alias("rep"), "sketch", *LEVELS).join(own.select("rep"), "rep", "left_semi")

    def again(deep: DataFrame) -> DataFrame:
        rows = _texts(docs, own.drop("n").join(deep, "rep", "left_semi"))
        return described(rows, runs_needed(1), runs_needed(DEPTH)).drop("key")

    rough = stage(components(candidates(sets, again)), "candidates")
    sizes = rough.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = rough.join(sizes, "component").join(own, rough["id"] == own["rep"]).drop("id")
    within = block_pairs(_texts(docs, wanted), "component", F.col("rep"), F.col("members"), SET_BLOCK)
    within = within.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(SET_BLOCK)), F.ceil(F.col("members") / F.lit(SET_BLOCK))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
            blocks, ids, n = (group.column(c).to_numpy() for c in ("own", "rep", "n"))
            near = similar(list(gram_sets(group.column("text").to_pylist())))
            near &= ids[:, None] != ids[None, :]
            counted = near if low == high else near & (blocks[:, None] != blocks[None, :])
            links = np.array(list(spanning_links(len(ids), lambda i, others: near[i, others])), int).reshape(-1, 2)  # noqa: B023
            linked = np.concatenate((ids, ids[links[:, 0]]))
            to = np.concatenate((ids, ids[links[:, 1]]))
            yield pa.RecordBatch.from_arrays([
                pa.array(linked), pa.array(to), pa.array(np.concatenate((counted @ n, np.zeros(len(links), n.dtype))))], ["a", "b", "links"])

    verified = stage(spread_groups(within.select("component", "low", "high", "own", "rep", "n", "text"), ["component", "low", "high"]).mapInArrow(
        verify, "a long, b long, links long"), "verified")
    found = components(verified.select("a", "b")).withColumnRenamed("id", "rep")
    near = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if not counts:
        return near.select("doc_id", "h", "component")
    counted = verified.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    return near.join(counted, "rep", "left").select("doc_id", "h", "component", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"))


def ngram_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    ``class_id`` is the least doc_id of the documents that links connect with this one,
    itself among them; null if none of them has one. ``n_links`` counts the other rows that
    it is linked with, repeated rows and rows of the same id too. Documents without words
    or with a null text link with nothing.
    """
    near = stage(near_documents(docs.select("doc_id", "text")), "near-documents")
    least = near.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return near.join(least.drop("rows"), "component", "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, and all rows without words; same columns.

    The row of the least id stays, null ids come last; of rows of that id the one lowest
    in a hash of its text, and of rows equal in both the one lowest in a hash of the row.
    So the other text of an id that is repeated stays, if nothing is like it.
    """
    near = stage(near_documents(docs.select("doc_id", "text"), counts=False).where("component IS NOT NULL"), "near-documents")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    groups = near.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    pairs = near.join(groups, "component").groupBy("doc_id", "h").agg(F.max(order == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("times"))
    pairs = stage(pairs.where("times > 1 OR NOT stays"), "gone-documents")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("h"))
    out = rows.join(pairs, _same(rows, pairs), "left_anti").select("row")
    repeated = pairs.where("stays")
    if not repeated.isEmpty():
        held = rows.join(repeated, _same(rows, repeated), "left_semi").groupBy("doc_id", "h").agg(
            F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.unionByName(held.select("row"))
    return out.select("row.*")


NGRAM_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
 WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) <= 5 THEN w ELSE w[i:i + 4] END AS s
 FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.8),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM documents JOIN m ON m.a = doc_id"""
