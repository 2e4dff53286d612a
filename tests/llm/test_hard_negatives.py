import numpy as np
from pyspark.sql import functions as F

from logprism.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor int, x int"


def brute(rows):
    usable = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int))
              for i, x, lab in rows if i is not None and lab is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    anchors = {(i, lab, tuple(x)) for i, lab, x in usable if i % 100 == 0}
    out = []
    for i, lab, x in anchors:
        scored = sorted((-int(np.dot(x, y)), j, m) for j, m, y in usable if len(y) == len(x))
        for p, j in [(-s, j) for s, j, m in scored if m == lab and j != i][:5]:
            fit = [(k, -s) for s, k, m in scored if m != lab and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(i, j, r, k, p, s) for r, (k, s) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.negatives_report(frame).collect())


def vectors(n=900, size=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    rows = [(i, (centres[i % 4] + rng.normal(size=size) * 0.6).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[100 * (i % 3)][1], i % 4) for i in range(120)]  # copies of anchors, ties
    return rows + rows[:3] + [rows[1]]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 100
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hn, "FIRST_DEPTH", 1)
    assert run(spark, rows) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1),
            (500, [1.0, 2.0], None), (600, [0.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 1.5], 1), (3, [1.0, 1.0], 2), (3, [1.0, 1.0], 2), (5, [1.0, 2.0, 3.0], 2),
            (800, [], 3), (801, [], 3), (802, [], 4), (900, [-1.0, -2.0], 1), (900, [-1.0, -1.0], 1), (900, [-1.0, -1.0], 1), (901, [-3.0, -0.5], 2), (902, [-1.0, -1.9], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    x = np.floor(rng.exponential(100, (20_000, 3))).astype(np.int64)
    lists = hn.Lists(x, np.arange(len(x)), np.zeros(len(x), int))
    anchor = np.array([300, -20, 0])
    rows, scores, met = hn.threshold_search(lists, anchor, lambda r: np.ones(r.size, bool), lambda s, edge: np.count_nonzero(s > edge) >= 5)
    assert sorted(-scores)[:5] == sorted(-(x @ anchor))[:5]
    assert met < 2000
    assert (lists.heads(anchor[None]) >= (x @ anchor).max()).all()
    assert (x[rows] @ anchor == scores).all()


def test_equal_scores_at_the_threshold_are_met():
    x = np.ones((3000, 2), np.int64)
    lists = hn.Lists(x, np.arange(3000)[::-1].copy(), np.zeros(3000, int))
    rows, _, _ = hn.threshold_search(lists, np.array([1, 1]), lambda r: np.ones(r.size, bool), lambda s, edge: np.count_nonzero(s > edge) >= 5)
    assert sorted(lists.ids[rows])[:5] == [0, 1, 2, 3, 4]


def test_moved_labels(spark):
    frame = spark.createDataFrame([(7, [1.0], 9, "", 0, 0), (8, [1.0], 9, "", 0, 0)], SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted((r["vec_id"], r["label"], r["x"]) for r in hn.usable(frame, moved).collect()) == [(7, 0, [256]), (8, 9, [256])]
