"""Language identification by interpolated Kneser-Ney models over characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logprism.llm.storage import release_memory

ORDER = 4
HISTORY = ORDER - 1
SAMPLE_ROWS = 400  # training texts per language, at most
SAMPLE_CHARS = 20_000  # of longer texts an excerpt is sampled, where a language lacks shorter ones
FOLDS = 8  # one in so many sampled texts calibrates the rejection
CHUNK = 1 << 18  # characters scored at a time
SLACK = 1.0  # nats per character above what calibration texts need
SPREAD = 8.0  # median deviations above the median beyond which a calibration text does not count
NOISE = 4.0  # nats by which short texts may exceed that, over the root of their length
SHARPNESS = 20.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Lower-case letters of a text, a space between and after runs of them, three spaces before."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the sign after a run becomes its space
    out = np.where(is_letter, points, SPACE)[keep].astype(np.uint32)
    if not out.size:
        return out
    after = [] if out[-1] == SPACE else [SPACE]
    return np.concatenate(([SPACE] * HISTORY, out, after)).astype(np.uint32)


def grams(signs: np.ndarray, order: int) -> np.ndarray:
    """A hash of the ``order`` signs that end at each place from ``order - 1`` on."""
    signs = signs.astype(np.uint64)
    hashed = np.zeros(max(0, signs.size - order + 1), np.uint64)
    for i in range(order):
        hashed = (hashed ^ signs[i:i + hashed.size]) * MULTIPLIER
        hashed ^= hashed >> np.uint64(29)
    return hashed


@dataclass(frozen=True)
class Model:
    """Sorted hash arrays: by order, the log probabilities of seen n-grams per language.

    ``keys[k]`` and ``logs[k]`` belong to n-grams of order k + 1. ``contexts[k]`` and
    ``weights[k]`` give the logarithm of the weight with which order k is used after a
    context of length k + 1. A gram's row holds each language's whole interpolated value.
    """

    langs: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    floor: np.ndarray
    limits: np.ndarray

    def signs_logs(self, signs: np.ndarray) -> np.ndarray:
        """Log probability of every sign after the first three, per language."""
        out = np.zeros((max(0, signs.size - HISTORY), len(self.langs)), np.float32)
        left = np.arange(len(out))
        for order in range(ORDER, 0, -1):
            first = left + HISTORY + 1 - order
            row, hit = _find(self.keys[order - 1], grams(signs, order)[first])
            out[left[hit]] += self.logs[order - 1][row[hit]]
            left, first = left[~hit], first[~hit]
            if not left.size:
                break
            if order > 1:
                row, known = _find(self.contexts[order - 2], grams(signs, order - 1)[first])
                out[left[known]] += self.weights[order - 2][row[known]]
            else:
                out[left] += self.floor
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not keys.size:
        return np.zeros(wanted.size, int), np.zeros(wanted.size, bool)
    row = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return row, keys[row] == wanted


def _counts(texts: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
    """By order: hashes of grams, of their contexts and of their shorter forms, and counts."""
    out = []
    for order in range(1, ORDER + 1):
        full, head, tail = ([] for _ in range(3))
        for signs in texts:
            if signs.size < order:
                continue
            full.append(grams(signs, order))
            if order > 1:
                head.append(grams(signs[:-1], order - 1))
                tail.append(grams(signs[1:], order - 1))
        empty = np.zeros(0, np.uint64)
        keys, at, counts = np.unique(np.concatenate(full or [empty]), return_index=True, return_counts=True)
        out.append({"keys": keys, "counts": counts,
                    "head": np.concatenate(head)[at] if head else np.zeros(keys.size, np.uint64),
                    "tail": np.concatenate(tail)[at] if tail else np.zeros(keys.size, np.uint64)})
    return out


def _kneser_ney(texts: list[np.ndarray], alphabet: int) -> list[dict[str, np.ndarray]]:
    """By order: keys, log probability, and the log weight of the shorter form per context."""
    levels = _counts(texts)
    for k in range(ORDER - 2, -1, -1):  # shorter forms count in how many longer ones they end
        ends, times = np.unique(levels[k + 1]["tail"], return_counts=True)
        row, hit = _find(ends, levels[k]["keys"])
        levels[k]["counts"] = np.where(hit, times[row] if times.size else 0, 1)
    for k, level in enumerate(levels):
        counts = level["counts"].astype(float)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, of, kinds = np.unique(level["head"], return_inverse=True, return_counts=True)
        total = np.bincount(of, counts, contexts.size) if contexts.size else np.zeros(0)
        weight = discount * kinds / np.maximum(total, 1)
        if k:
            row, hit = _find(levels[k - 1]["keys"], level["tail"])
            shorter = np.where(hit, levels[k - 1]["p"][row], 1 / alphabet)
        else:
            shorter = 1 / alphabet
        level["p"] = np.maximum(counts - discount, 0) / np.maximum(total, 1)[of] + weight[of] * shorter
        level["contexts"], level["weight"] = contexts, weight
    return levels


def _usual(entropy: np.ndarray) -> float:
    """The maximum of what calibration texts need, but no more than ``SPREAD`` median deviations above
    their median, so that odd or mislabelled texts, while they are few, do not set it."""
    if not entropy.size:
        return 0.0
    middle = float(np.median(entropy))
    return min(float(entropy.max()), middle + SPREAD * float(np.median(np.abs(entropy - middle))))


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of the texts per language; one text in ``FOLDS`` only sets its limit of rejection."""
    langs = tuple(sorted(samples))
    signs = {x: [c for c in map(codes, samples[x]) if c.size] for x in langs}
    alphabet = len(set().union(*(np.unique(c).tolist() for x in langs for c in signs[x]))) + 1
    train = {x: [c for i, c in enumerate(signs[x]) if i % FOLDS] or signs[x] for x in langs}
    fitted = [_kneser_ney(train[x], alphabet) for x in langs]
    keys, logs, contexts, weights = [], [], [], []
    floor = np.array([np.log(max(f[0]["weight"].max(initial=1e-3), 1e-6) / alphabet) for f in fitted], np.float32)
    for k in range(ORDER):
        every = np.unique(np.concatenate([f[k]["keys"] for f in fitted] or [np.zeros(0, np.uint64)]))
        heads = np.zeros(every.size, np.uint64)
        tails = np.zeros(every.size, np.uint64)
        for f in fitted:
            at = np.searchsorted(every, f[k]["keys"])
            heads[at], tails[at] = f[k]["head"], f[k]["tail"]
        table = np.zeros((every.size, len(langs)), np.float32)
        for i, f in enumerate(fitted):
            row, hit = _find(f[k]["keys"], every)
            table[hit, i] = np.log(f[k]["p"][row[hit]])
            table[~hit, i] = floor[i]
            if k:
                row, known = _find(f[k]["contexts"], heads)
                back = np.where(known, np.log(np.maximum(f[k]["weight"][row], 1e-9)) if f[k]["weight"].size else 0, 0)
                row, had = _find(keys[k - 1], tails)
                shorter = np.where(had, logs[k - 1][row, i], floor[i])
                table[~hit, i] = (back + shorter)[~hit]
        keys.append(every)
        logs.append(table)
        if k:
            every = np.unique(np.concatenate([f[k]["contexts"] for f in fitted] or [np.zeros(0, np.uint64)]))
            table = np.zeros((every.size, len(langs)), np.float32)
            for i, f in enumerate(fitted):
                row, hit = _find(f[k]["contexts"], every)
                table[hit, i] = np.log(np.maximum(f[k]["weight"][row[hit]], 1e-9))
            contexts.append(every)
            weights.append(table)
    model = Model(langs, tuple(keys), tuple(logs), tuple(contexts), tuple(weights), floor, np.zeros(len(langs)))
    limits = []
    for i, lang in enumerate(langs):
        entropy = [-model.signs_logs(c)[:, i].mean() - NOISE / np.sqrt(c.size - HISTORY) for n, c in enumerate(signs[lang]) if n % FOLDS == 0]
        limits.append(_usual(np.array(entropy)) + SLACK)
    return Model(langs, *(getattr(model, x) for x in ("keys", "logs", "contexts", "weights", "floor")), np.array(limits))


def training_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Up to ``rows`` texts per language, lowest in a hash of text; equal texts count once.

    Where a language has fewer texts of up to ``chars`` characters, longer ones fill its
    sample with as many characters from a place their hash tells, or from their first
    letter if there is none in these. The driver gets no more than rows x chars x languages characters.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    hashed = usable.select("lang", "text", F.xxhash64("text").alias("h"), (F.length("text") > chars).alias("long"))
    # Most rows are out of the question by their hash alone, so that no task gets many candidates.
    kinds = hashed.groupBy("lang", "long").agg(F.approx_count_distinct("h").alias("kinds")).select(
        F.col("lang").alias("_lang"), F.col("long").alias("_long"), "kinds")
    share = F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("kinds"))
    near = hashed.select("lang", "long", "h").join(F.broadcast(kinds), (F.col("lang") == F.col("_lang")) & (F.col("long") == F.col("_long"))).where(
        F.col("h").cast("double") < share * 2.0**64 - 2.0**63)
    best = near.groupBy("lang", "long", "h").count().withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))).where(F.col("k") <= rows)
    # at most rows x languages hashes
    chosen = hashed.join(F.broadcast(best.select("lang", "long", "h")), ["lang", "long", "h"])
    start = F.pmod(F.col("h"), F.length("text") - chars + 1).cast("int") + 1
    part = F.substr("text", start, F.lit(chars))
    lettered = F.when(F.rlike(part, F.lit(r"\p{L}")), part).otherwise(
        F.substr(F.regexp_extract("text", r"(?s)\p{L}.*+", 0), F.lit(1), F.lit(chars)))
    found = chosen.select("lang", "h", F.when(F.col("long"), lettered).otherwise(F.col("text")).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(row["lang"], []).append(row["text"])
    return samples


def _entropies(model: Model, signs: list[np.ndarray]) -> np.ndarray:
    """Cross-entropy per character of texts, by language."""
    joined = np.concatenate(signs)
    starts = np.cumsum([0] + [s.size for s in signs[:-1]])
    logs = model.signs_logs(joined)
    logs = np.concatenate((np.zeros((HISTORY, len(model.langs)), np.float32), logs))
    logs[(starts[:, None] + np.arange(HISTORY)).ravel()] = 0  # these only are the past of what follows
    sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
    return -sums / (np.array([s.size for s in signs]) - HISTORY)[:, None]


def _long_entropy(model: Model, signs: np.ndarray) -> np.ndarray:
    """The same of one long text, in overlapping parts."""
    sums = sum(model.signs_logs(signs[i - HISTORY:i + CHUNK]).sum(0, dtype=float) for i in range(HISTORY, signs.size, CHUNK))
    return -sums[None] / (signs.size - HISTORY)


def _score(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
    """Language, score and rejection of each text. Texts are scored some at a time, so memory stays small."""

    def verdicts(lot: list[np.ndarray]) -> Iterator[tuple[str, float, bool]]:
        used = [s for s in lot if s.size]
        found = iter([])
        if used and model.langs:
            found = iter(_long_entropy(model, used[0]) if used[0].size > CHUNK else _entropies(model, used))
        for s in lot:
            if not s.size or not model.langs:
                yield "und", 0.0, True
                continue
            entropy = next(found)
            best = int(entropy.argmin())
            score = 1 / np.exp(-SHARPNESS * (entropy - entropy[best])).sum()
            yield model.langs[best], float(score), bool(entropy[best] - NOISE / np.sqrt(s.size - HISTORY) > model.limits[best])

    lot, size = [], 0
    for text in texts:
        signs = codes(text) if text else np.zeros(0, np.uint32)
        if lot and size + signs.size > CHUNK:
            yield from verdicts(lot)
            lot, size = [], 0
        lot.append(signs)
        size += signs.size
    if lot:
        yield from verdicts(lot)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns) with lang_pred, score and rejected.

    The language with the lowest cross-entropy per character of the whole text wins;
    ties go to the first by name. ``score`` falls from 1 as others come near. A text
    is rejected if its entropy exceeds the language's limit, which comes from
    calibration texts, odd ones among them left out. A null text or one without letters is ``und``, score 0, rejected.
    Only the text is used.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct("*").alias("row"), F.col("text").alias("_text"))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [None if t is None else t for t in texts]
            yield pd.DataFrame(_score(held.value, values), columns=["lang_pred", "score", "rejected"])
        release_memory()

    return kept.select("row", score("_text").alias("p")).select("row", "p.*")


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model of the documents that are not held out: crc32 of the id as text, mod 4, is not 2."""
    model = fit(training_sample(docs.where(~held_out()), rows))
    release_memory()
    return model


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    scored = predict(docs.select("doc_id", "text"), learn(docs))
    return scored.select("row.doc_id", "lang_pred", "score", "rejected").select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    return predict(docs, learn(docs)).where(~F.col("rejected")).select("row.*")
