import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logprism.llm import knn

SCHEMA = "vec_id long, embedding array<float>, extra string, score long"


def brute(rows, top):
    usable = [(i, np.floor(64 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows
              if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = set()
    for q, x in usable:
        if q % 20 == 0:
            found = sorted((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x))[:top]
            out |= {(q, k, i, -s) for k, (s, i) in enumerate(found, 1)}
    return out


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(i, x, "e", 7) for i, x in rows], SCHEMA)
    found = knn.knn_join(knn.quantised(frame), F.col("vec_id") % 20 == 0, **settings)
    return {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()}


def test_against_brute_force_with_few_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 5
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 440)]  # copies: ties by id
    assert run(spark, rows, top=5, pivots=8) == brute(rows, 5)


def test_distant_data_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_QUERIES", 1)
    rows = [(i, [100.0 + i % 3, 0.0] if i % 2 == 0 else [-100.0 - i % 3, 0.0]) for i in range(200)]
    assert run(spark, rows, top=3, pivots=2) == brute(rows, 3)


def test_hot_cells_are_cut_and_meet_only_blocks_with_data(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    tasks, spread = [], knn.spread_groups

    def seen(rows, keys):
        tasks.extend(rows.groupBy(*keys).agg(F.sum("asks").alias("asks"), F.count(F.when(F.col("asks") == 0, 1)).alias("data")).collect())
        return spread(rows, keys)

    monkeypatch.setattr(knn, "spread_groups", seen)
    rng = np.random.default_rng(5)
    rows = [(20 * i, (np.array([50.0, 0.0]) + rng.normal(size=2) * 0.5).tolist()) for i in range(60)]  # a cell of queries
    rows += [(20 * i + 1, (np.array([-50.0, 0.0]) + rng.normal(size=2) * 0.5).tolist()) for i in range(300)]
    assert run(spark, rows, top=3, pivots=2) == brute(rows, 3)
    assert tasks and max(r["asks"] for r in tasks) <= 4
    assert all(r["data"] for r in tasks if r["asks"])
    assert max(r["data"] for r in tasks) <= 32


def test_copies_are_one_pivot(spark):
    rows = spark.createDataFrame([([7, 7],)] * 500 + [([i, -i],) for i in range(5)], "x array<long>")
    assert len(knn._pivots(rows, 2, 6)) == 6


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (20, [0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [-1.0, 0.5]), (40, []), (41, [])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == set()
    assert run(spark, [(0, [1.0])]) == set()


def test_best_rows_break_ties_by_id():
    assert knn.best_rows(np.array([5, 7, 7, 7, 1]), np.arange(5), 2).tolist() == [1, 2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=5))
def test_products_are_exact(rows):
    a = np.array(rows, np.int64)
    wide = [[sum(x * y for x, y in zip(p, q)) for q in rows] for p in rows]
    assert knn.products(a, a).tolist() == [[(v + 2**63) % 2**64 - 2**63 for v in r] for r in wide]
