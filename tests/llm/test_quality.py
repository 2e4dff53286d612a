import itertools
import random
import zlib

import numpy as np
import pytest

from logprism.llm import quality as q

WORDS = "the of and to in that was river stone light paper winter".split()


def good(rng):
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(5, 15))).capitalize() + "." for _ in range(rng.randint(2, 6)))


def bad(rng):
    return rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + "###" for w in t.split()), lambda t: (rng.choice(WORDS) + " ") * 40])(good(rng))


def corpus(n=400):
    rng = random.Random(3)
    labels = [int(rng.random() < 0.8) for _ in range(n)]
    return [(i, (good if y else bad)(rng), "xx", None) for i, y in enumerate(labels)], list(enumerate(labels))


def frame(spark, labels):
    return spark.createDataFrame([(i, y, 0, "r") for i, y in labels], "doc_id long, quality int, toxic int, row string")


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark, docs_frame):
    docs, labels = corpus()
    found = {r["doc_id"]: r for r in q.quality_report(docs_frame(docs), frame(spark, labels)).collect()}
    assert len(found) == len(docs)
    assert all(r["held_out"] == is_held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    held = [(found[i]["score"], y) for i, y in labels if is_held(i)]
    ordered = np.mean([(a > b) + (a == b) / 2 for (a, y), (b, z) in itertools.product(held, held) if y > z])
    assert ordered > 0.98
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


def test_held_out_labels_and_other_columns_have_no_effect(spark, docs_frame):
    docs, labels = corpus(150)
    a = {tuple(r) for r in q.quality_report(docs_frame(docs), frame(spark, labels)).collect()}
    changed = [(i, 1 - y if is_held(i) else y) for i, y in labels] + [(9999, 1), (None, 0), (1, None), (2, 7)]
    other = [(i, t, "yy", f"s{i}") for i, t, _, _ in docs]
    assert {tuple(r) for r in q.quality_report(docs_frame(other), frame(spark, changed)).collect()} == a


def rows(n, buckets, seed=0):
    rng = np.random.default_rng(seed)
    return [(rng.integers(0, buckets, k).astype(np.int32), rng.random(k).astype(np.float32)) for k in rng.integers(1, 9, n)]


def test_pairs_in_linear_time(monkeypatch):
    monkeypatch.setattr(q, "LOT", 7)
    model, some = q.Machine.empty(20, 3), rows(12, 20)
    model.factors *= 10
    model.weights[:], model.bias = np.arange(20) / 20, 0.3
    want = [model.bias + sum(model.weights[i] * x for i, x in zip(*r)) + sum(
        float(model.factors[i] @ model.factors[j]) * x * y for (i, x), (j, y) in itertools.combinations(list(zip(*r)), 2)) for r in some]
    assert model.probabilities(some) == pytest.approx(q.logistic(np.array(want)), rel=1e-5)


def test_pairs_are_learned():
    """Whether two features agree: no single feature tells."""
    made = [(np.array([a, 2 + b], np.int32), np.ones(2, np.float32)) for a in (0, 1) for b in (0, 1)] * 50
    labels = np.array([float((r[0][0] == 0) == (r[0][1] == 2)) for r in made])
    assert (np.abs(q.fit(made, labels, 600, 4).probabilities(made) - labels) < 0.2).all()


def test_same_rows_same_machine():
    a, b = (q.fit(rows(90, 50), np.arange(90) % 2.0, 30, 50) for _ in range(2))
    assert (a.factors == b.factors).all() and a.bias == b.bias


def test_odd_rows(spark, docs_frame):
    docs, labels = corpus(120)
    odd = [(1000, None, None, None), (1001, "", None, None), (1002, " \n$$", None, None), (None, good(random.Random(1)), None, None), (1003, "a b " * 300_000, None, None),
           (1004, "x" * 2_000_000, None, None), (5, docs[5][1], None, None), (5, docs[7][1], None, None)]
    scored = q.quality_report(docs_frame(docs + odd), frame(spark, labels + labels[:9] + [(1000, 0), (1003, 0), (6, 1 - labels[6][1])])).collect()
    assert len(scored) == len(docs) + len(odd)
    found = {r["doc_id"]: r for r in scored}
    assert found[None]["held_out"] is False and found[1000]["score"] == found[1001]["score"]
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert q.quality_report(docs_frame([]), frame(spark, [])).collect() == []
    assert [r["score"] for r in q.quality_report(docs_frame(docs[:2]), frame(spark, [])).collect()] == pytest.approx([0.5] * 2, abs=0.1)


def test_sample_is_bounded(spark, docs_frame, monkeypatch):
    docs, labels = corpus(100)
    seen = []
    monkeypatch.setattr(q, "fit", lambda rows, y: seen.append((rows, y)))
    q.learn(docs_frame(docs), frame(spark, labels), 20, 30)
    (some, y), = seen
    assert len(some) == len(y) == 20 and max(r[0].size for r in some) <= q.STATS + 15
    seen.clear()
    q.learn(docs_frame(docs), frame(spark, labels))
    assert len(seen[0][0]) == sum(not is_held(i) for i, _ in labels)


def test_row_and_its_columns_stay(spark, docs_frame):
    docs = docs_frame([(1, "some text", None, None)]).selectExpr("*", "1 AS score", "2 AS row").drop("n_chars")
    assert q.score(docs, q.Machine.empty()).select("row.*").columns == docs.columns
