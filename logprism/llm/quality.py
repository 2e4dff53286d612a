"""Quality of texts by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logprism.llm.storage import release_memory
from logprism.llm.terms import terms

BUCKETS = 1 << 18  # of features; the first hold structure and metadata
BINS = 16
FACTORS = 8
SAMPLE_ROWS = 8000  # labelled rows that are learned from
SAMPLE_CHARS = 20_000  # of a longer text an excerpt is learned from
STEPS = 400  # of training, at least; each row is seen twice at least
BATCH = 64
RATE = 0.4
DECAY = 1e-5
LOT = 1 << 18  # features scored at a time
THRESHOLD = 0.3
CACHED = 1 << 17  # words whose bucket a worker remembers

# Kinds of bytes: upper, lower, digit, blank, line break, common sign, other sign, part of a sign beyond ASCII
UPPER, LOWER, DIGIT, BLANK, BREAK, COMMON, OTHER, WIDE = range(8)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[128:], KINDS[ord("A"):ord("Z") + 1], KINDS[ord("a"):ord("z") + 1], KINDS[ord("0"):ord("9") + 1] = WIDE, UPPER, LOWER, DIGIT
KINDS[[32, 9, 11, 12, 13]], KINDS[10], KINDS[[ord(c) for c in ".,;:'\"?-()"]] = BLANK, BREAK, COMMON
STATS = 14  # with the metadata
STAT_VALUE = 0.8


def _share(part: float, whole: float) -> int:
    """The bin of a share; small shares are told apart best."""
    return min(BINS - 1, int((part / whole) ** 0.4 * (BINS - 1) + 0.5)) if whole else 0


def _size(n: float) -> int:
    return min(BINS - 1, int(n).bit_length())


def structure(text: str, words: int, kinds: Counter, repeats: int, n_chars: int | None) -> list[int]:
    """The bins of a text's figures, of which each makes one feature."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    of = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=8).tolist()
    lines = data.split(b"\n")
    figures = [
        _share(of[UPPER], of[UPPER] + of[LOWER]), _share(of[DIGIT], n), _share(of[OTHER], n), _share(of[COMMON], n), _share(of[WIDE], n),
        _share(of[BLANK] + of[BREAK], n), _size(n), _size(words), _share(len(kinds), words), _share(max(kinds.values(), default=0), words),
        _share(repeats, words), _share(len(lines) - len(set(lines)), len(lines)), _size(4 * n / max(words, 1)),
        0 if n_chars is None or n_chars < 0 else 1 + min(BINS - 2, n_chars.bit_length() // 2),
    ]
    return [BINS * i + x for i, x in enumerate(figures)]


class Buckets(dict):
    """The bucket of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = bucket = STATS * BINS + xxhash.xxh64_intdigest(word) % (BUCKETS - STATS * BINS)
        return bucket


def features(text: str | None, n_chars: int | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the features of a whole text. A null text is empty.

    Each distinct word counts with the root of its share of all words, so that the squares
    of the words' values sum to 1; each figure of structure and metadata counts with 0.8.
    """
    text = text or ""
    kinds, words, repeats, before = Counter(), 0, 0, None
    for part in terms(text):
        kinds.update(part)
        repeats += sum(map(eq, part, part[1:])) + (bool(part) and part[0] == before)
        words, before = words + len(part), part[-1] if part else before
    figures = structure(text, words, kinds, repeats, n_chars)
    index = np.fromiter((*figures, *map(buckets.__getitem__, kinds)), np.int32, STATS + len(kinds))
    value = np.full(index.size, STAT_VALUE, np.float32)
    value[STATS:] = np.sqrt(np.fromiter(kinds.values(), float, len(kinds)) / max(words, 1))
    return index, value


@dataclass
class Machine:
    """A factorisation machine: bias + w.x + the sum over pairs i < j of (v_i . v_j) x_i x_j."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def empty(cls, buckets: int = BUCKETS, factors: int = FACTORS) -> Machine:
        start = np.random.default_rng(7).normal(0, 0.05, (buckets, factors))
        return cls(0.0, np.zeros(buckets, np.float32), start.astype(np.float32))

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of at least one feature: outputs, the sums of v x by factor, and v x by feature.

        The pairs cost no more than the features: their sum is half of (sum of v x) squared
        less the sum of (v x) squared, by factor.
        """
        own = self.factors[index] * value[:, None]
        sums = np.add.reduceat(own, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", own, own), starts)
        pairs = 0.5 * ((sums**2).sum(1) - squares)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + pairs, sums, own

    def probabilities(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The probability of label 1 of each row; rows are worked on some at a time."""
        out, at = [], 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + rows[end][0].size <= LOT):
                size, end = size + rows[end][0].size, end + 1
            out.append(self.raw(*joined(rows[at:end]))[0].astype(float))
            at = end
        return logistic(np.concatenate(out)) if out else np.zeros(0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    return index, value, np.cumsum([0, *(r[0].size for r in rows[:-1])])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, buckets: int = BUCKETS) -> Machine:
    """Logistic loss, gradients scaled by their history (Adagrad); the same result for the same rows in order."""
    model, rng = Machine.empty(buckets), np.random.default_rng(11)
    if not rows:
        return model
    share = (labels.sum() + 0.5) / (labels.size + 1)
    model.bias = float(np.log(share / (1 - share)))
    past_w, past_v, past_b = np.full(buckets, 0.1, np.float32), np.full(model.factors.shape, 0.1, np.float32), 0.1
    for _ in range(max(2, -(-steps * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for first in range(0, order.size, BATCH):
            part = order[first:first + BATCH]
            index, value, starts = joined([rows[i] for i in part])
            out, sums, own = model.raw(index, value, starts)
            error = ((logistic(out.astype(float)) - labels[part]) / part.size).astype(np.float32)
            owner = np.repeat(np.arange(part.size), np.diff([*starts, index.size]))
            scaled = (error[owner] * value)[:, None]
            by = np.argsort(index, kind="stable")
            where, at = np.unique(index[by], return_index=True)
            w = np.add.reduceat(scaled[by, 0], at) + DECAY * model.weights[where]
            v = np.add.reduceat((scaled * (sums[owner] - own))[by], at) + DECAY * model.factors[where]
            past_w[where] += w**2
            past_v[where] += v**2
            past_b += float(error.sum()) ** 2
            model.weights[where] -= RATE * w / np.sqrt(past_w[where])
            model.factors[where] -= RATE * v / np.sqrt(past_v[where])
            model.bias -= RATE * float(error.sum()) / past_b**0.5
    return model


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def _n_chars(docs: DataFrame) -> Column:
    """The documents' n_chars, null if they have none."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Machine:
    """The machine fitted to documents that are not held out and have a label of 0 or 1.

    If there are more than ``rows`` different ones, those lowest in a hash of id and text.
    Of texts of more than ``chars`` characters, so many from a place that the hash tells.
    A document with both labels counts with both. The driver gets the features of the
    sample, at most one per word of rows x chars characters.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    texts = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _n_chars(docs).alias("n_chars"))
    hashed = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    lowest = hashed.select("doc_id", "h").join(known, "doc_id").distinct().orderBy("h", "doc_id", "quality").limit(rows)
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    part = hashed.select("doc_id", "h", F.substr("text", start, F.lit(chars)).alias("text"), "n_chars")
    chosen = part.join(F.broadcast(lowest), ["doc_id", "h"])  # at most rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            found = [features(t, n, buckets) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(0), batch.column(4), pa.array([i for i, _ in found], pa.list_(pa.int32())),
                pa.array([v for _, v in found], pa.list_(pa.float32()))], ["h", "doc_id", "quality", "i", "v"])

    sample = chosen.select("doc_id", "h", "text", "n_chars", "quality").mapInArrow(
        describe, "h long, doc_id long, quality int, i array<int>, v array<float>").toArrow().sort_by(
        [("h", "ascending"), ("doc_id", "ascending"), ("quality", "ascending")])
    flat = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(sample.column("i"), sample.column("v"), strict=True)]
    keys = list(zip(*(sample.column(c).to_pylist() for c in ("h", "doc_id", "quality")), strict=True))
    first = [k for k, key in enumerate(keys) if not k or key != keys[k - 1]]  # equal rows count once
    return fit([flat[k] for k in first], np.array([keys[k][2] for k in first], float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """``row`` (all columns) with score, the probability of label 1, from the whole text and n_chars alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts, sizes in batches:
            out = np.zeros(len(texts))
            known = [None if pd.isna(n) else int(n) for n in sizes]
            for at in range(0, len(texts), 256):
                part = [features(t, n, buckets) for t, n in zip(texts[at:at + 256], known[at:at + 256], strict=True)]
                out[at:at + 256] = held.value.probabilities(part)
            yield pd.Series(out)
        release_memory()

    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"), _n_chars(docs).alias("_n"))
    return rows.select("row", scored("_text", "_n").alias("score"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    found = score(docs.select("doc_id", "text", "n_chars"), learn(docs, labels)).select("row.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
