import random

import pytest

from logprism.llm import mixing


def targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    return {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}


def reshared(sizes):
    """The rule itself: reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def test_targets_follow_the_rule(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(n)} | {None: 12}
        got, want = targets(spark, sizes), reshared(sizes)
        assert got.keys() == want.keys()
        for s in got:
            assert got[s] == pytest.approx(want[s], rel=1e-9)


def test_taken_words_come_near_the_targets(spark, docs_frame):
    rng = random.Random(1)
    rows = [(i, "w " * int(1 + rng.expovariate(1 / 40)), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(6000)]
    docs = docs_frame(rows)
    found = mixing.mixed_sizes(docs).collect()
    assert len(found) == 6000
    sources = {r[0]: r[3] for r in rows}
    for s in {r[3] for r in rows}:
        own = [r for r in found if sources[r["doc_id"]] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.03)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in found}
    times = {}
    for r in mixing.mix(docs).select("doc_id").collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert {r["doc_id"]: r["taken"] // r["size"] for r in found if r["taken"]} == times


def test_odd_rows(spark, docs_frame):
    rows = [(None, None, None, None), (1, "", "en", ""), (1, "a b", "en", ""), (1, "a b", "en", ""), (-5, "\x1c x\x0b\x0cy", None, "z"), (7, "w " * 30000, None, "z")]
    got = mixing.mixed_sizes(docs_frame(rows)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 3, 30000]
    assert mixing.mixed_sizes(docs_frame([])).collect() == []
    clash = docs_frame(rows).selectExpr("*", "9 AS size", "8 AS copies", "7 AS target", "6 AS row", "5 AS _source")
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns
    assert {r["size"] for r in mixed.collect()} <= {9}
    nothing = docs_frame([(1, "", None, "a"), (2, None, None, "b")])
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mixed_sizes(nothing).collect())
