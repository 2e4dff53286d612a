"""Ranked lexical search: documents of an item grouped by the mask of its terms that they hold."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logprism.llm.prefix import prefix_sums
from logprism.llm.storage import release_memory, stage
from logprism.llm.terms import terms

TOP = 50
BLOCK_TERMS = 1 << 17  # terms of items that are asked in one pass over the documents
CELLS = 1 << 22  # of a matrix of terms and documents
FIRST_LOOK = 64  # documents scored before the bound is asked again; then twice as many each time
POSTINGS = "doc_id long, n long, term array<int>, tf array<int>"
NULL_ID = np.int64(2**63 - 1)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item. Rows of one item_id are one item, null is an id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in terms(text):
                    found = list(set(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, term binary").distinct()


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """item_id, term, part: items in parts of about ``BLOCK_TERMS`` terms, and how many parts there are."""
    asked = stage(item_terms(items), "item-terms")
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    lots = -(-total // BLOCK_TERMS)
    keyed = sizes.withColumn("one", F.lit(0)).withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(max(1, lots))))
    placed = prefix_sums(keyed, "one", "lot", [F.col("item_id")], "size", "before")
    placed = placed.select(F.col("item_id").alias("_id"), F.floor(F.col("before") / F.lit(BLOCK_TERMS)).cast("int").alias("part"))
    return asked.join(placed, F.col("item_id").eqNullSafe(F.col("_id"))).select("item_id", "term", "part"), lots


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document with terms: how many it has, and the numbers and frequencies of those in ``vocabulary``."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of a part of the items

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(held.value)}
        for batch in batches:
            columns = [[], [], [], []]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = 0, Counter()
                for part in terms(text):
                    n += len(part)
                    times = Counter(part)
                    for t in times.keys() & number.keys():
                        found[number[t]] += times[t]
                if n:
                    for column, value in zip(columns, (name, n, list(found), list(found.values())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n", "term", "tf"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, POSTINGS)


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def corpus_counts(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and of each term of the vocabulary the documents holding it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(_flat(batch.column(1)), minlength=size)
            docs, words = docs + batch.num_rows, words + int(batch.column(0).to_numpy().sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2))), pa.array(np.append(held[some], (docs, words)))], ["key", "n"])

    sums = index.select("n", "term").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = {r["key"]: r["n"] for r in sums.collect()}  # at most one row per term of this part of the items
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


@dataclass
class Best:
    """The highest scores of an item so far, ties to smaller ids, null ids last."""

    top: int
    scores: np.ndarray
    ids: np.ndarray

    @property
    def least(self) -> int:
        """What a score must reach to count: it is above 0, and with ``top`` results no lower than the last."""
        return max(1, int(self.scores[-1])) if self.scores.size >= self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        scores, ids = np.concatenate((self.scores, scores[some])), np.concatenate((self.ids, ids[some]))
        order = np.lexsort((ids, -scores))[:self.top]
        self.scores, self.ids = scores[order], ids[order]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of a term's weight that a document's score gets; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def masks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of terms x documents, the distinct columns (as rows) and each document's number among them."""
    packed = np.packbits(held, axis=0)
    words = np.zeros((held.shape[1], -(-packed.shape[0] // 8) * 8), np.uint8)
    words[:, :packed.shape[0]] = packed.T
    words = words.view(np.uint64)
    if words.shape[1] == 1:
        _, at, of = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        _, at, of = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return held[:, at].T, of.ravel()


def search_masks(tf: np.ndarray, m: np.ndarray, ids: np.ndarray, weights: np.ndarray, most: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what of these documents belongs there; returns how many were scored.

    ``tf`` is terms x documents, ``most`` the highest score that each term can give here.
    Documents are grouped by the mask of terms they hold. A mask's documents score no more
    than its terms' ``most`` together; masks are scored from the highest such sum down, and
    the search ends where it falls below the last result, strictly, as ties may count.
    """
    kinds, of = masks(tf > 0)
    bound = kinds.astype(np.int64) @ most
    by_bound = np.argsort(-bound, kind="stable")
    rank = np.empty_like(by_bound)
    rank[by_bound] = np.arange(by_bound.size)
    order = np.argsort(rank[of], kind="stable")  # documents by the bound of their mask
    ends = np.cumsum(np.bincount(rank[of], minlength=by_bound.size))
    falling = -bound[by_bound]
    at, group, look = 0, 0, FIRST_LOOK
    while group < ends.size:
        last = int(np.searchsorted(falling, -best.least, side="right"))  # masks that may still count
        if last <= group:
            break
        group = min(last, max(group + 1, int(np.searchsorted(ends, at + look, side="right"))))  # what fits, a mask at least
        end = int(ends[group - 1])
        rows = order[at:end]
        part = tf[:, rows].astype(np.int64)
        best.add((weights[:, None] * impact(part, m[rows])).sum(0), ids[rows])
        at, look = end, 2 * look
    return at


def search_block(index: DataFrame, asked: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The ``top`` documents of each item (id, numbers of its terms) as item_id, doc_id, score, per task."""
    held = index.sparkSession.sparkContext.broadcast((asked, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        best = [Best(top, np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for batch in batches:
            ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            m = 100 - 50 + 50 * batch.column(1).to_numpy() * n_docs // n_terms
            numbers, tf = _flat(batch.column(2)), _flat(batch.column(3))
            order = np.argsort(numbers, kind="stable")
            rows = np.repeat(np.arange(len(ids)), np.diff(batch.column(2).offsets.to_numpy()))[order]
            numbers, tf = numbers[order], tf[order]
            bounds = np.searchsorted(numbers, np.arange(weight.size + 1))
            starts = np.flatnonzero(np.diff(bounds))
            most = np.zeros(weight.size, np.int64)
            if starts.size:
                first = bounds[:-1][starts]
                most[starts] = weight[starts] * impact(np.maximum.reduceat(tf, first).astype(np.int64), np.minimum.reduceat(m[rows], first))
            for (_, own), found in zip(items, best, strict=True):
                here = own[most[own] > 0]
                if not here.size or most[here].sum() < found.least:
                    continue
                step = max(1, CELLS // here.size)  # documents at a time
                for low in range(0, len(ids), step):
                    matrix = np.zeros((here.size, min(step, len(ids) - low)), np.int32)
                    for row, t in enumerate(here):
                        mine = slice(bounds[t], bounds[t + 1])
                        at = slice(*np.searchsorted(rows[mine], (low, low + step)))
                        matrix[row, rows[mine][at] - low] = tf[mine][at]
                    some = np.flatnonzero(matrix.any(0))
                    if some.size:
                        search_masks(matrix[:, some], m[low + some], ids[low + some], weight[here], most[here], found)
        for (name, _), found in zip(items, best, strict=True):
            if found.ids.size:
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * found.ids.size, pa.int64()), pa.array(found.ids, pa.int64(), mask=found.ids == NULL_ID),
                    pa.array(found.scores, pa.int64())], ["item_id", "doc_id", "score"])
        release_memory()

    return index.mapInArrow(search, "item_id long, doc_id long, score long")


def term_weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Per item its ``top`` documents of highest score above 0: item_id, rank, doc_id, score.

    ``docs`` holds doc_id and text, ``items`` item_id and text. Whole texts are counted, null
    and empty ones hold no terms. Rows of one item_id (null is one) are one item with the
    terms of all; an item without terms, or whose terms no document holds, gets no rows.
    Every row of ``docs`` is a document, also where ids repeat or are null. Equal scores go
    by ascending doc_id, nulls last.

    Items are asked in parts of about ``BLOCK_TERMS`` terms, a pass over the documents for
    each. In a pass the frequencies of the part's terms are written per document (postings),
    their document counts summed, and every task searches its own documents by presence
    masks, keeping ``top`` results per item from one batch to the next. Only these are
    shuffled to be ranked.
    """
    spark = docs.sparkSession
    asked, parts = item_blocks(items)
    out = None
    for part in range(parts):
        rows = asked.where(F.col("part") == part).select("item_id", "term").collect()  # about BLOCK_TERMS, or one item's
        vocabulary = sorted({bytes(r["term"]) for r in rows})
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        own: dict[int | None, list[int]] = {}
        for r in rows:
            own.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
        index = stage(postings(docs, vocabulary), "postings")
        n_docs, n_terms, df = corpus_counts(index, len(vocabulary))
        weights = np.array([term_weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
        found = search_block(index, [(k, np.array(sorted(v))) for k, v in own.items()], weights, n_docs, n_terms, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SEARCH_SQL = f"""
WITH d AS (SELECT r, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT r, count(*) AS words FROM d GROUP BY r),
c AS (SELECT count(*) AS docs, CAST(sum(words) AS BIGINT) AS total FROM l),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
m AS (SELECT r, 100 - 50 + (50 * words * docs) // total AS m FROM l, c),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
 FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""
