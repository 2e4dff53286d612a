from pyspark.sql import functions as F

from logprism.llm.ranges import range_cuts, range_number, weighed_ranges


def weights(spark, keys, target):
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    cuts = range_cuts(frame, "k", F.lit(1), target)
    numbers = {r["k"]: r["n"] for r in frame.select("k", range_number(F.col("k"), cuts).alias("n")).collect()}
    held = {}
    for k in keys:
        held[numbers[k]] = held.get(numbers[k], 0) + 1
    ordered = [numbers[k] for k in sorted(k for k in keys if k is not None)]
    assert ordered == sorted(ordered)
    assert set(held) <= set(range(max(1, len(cuts))))
    return held


def test_even_and_skewed_keys(spark):
    assert max(weights(spark, list(range(1000)), 50).values()) <= 50
    crowded = [5_000_000_000 + i for i in range(900)] + [-(2**63), 2**63 - 1, None, None]
    held = weights(spark, crowded, 60)
    assert max(held.values()) <= 60 and len(held) < 60
    assert weights(spark, [7] * 500 + [8], 10) == {0: 500, 1: 1}
    assert weights(spark, [None, None], 10) == {0: 2}
    assert weights(spark, [], 10) == {}


def test_weights_of_ranges_and_nulls(spark):
    frame = spark.createDataFrame([(k,) for k in [None] * 7 + [3] * 50 + list(range(100, 130))], "k long")
    cuts, held, nulls = weighed_ranges(frame, "k", F.lit(1), 10)
    assert nulls == 7 and sum(held) == 80 and held[cuts.index(3)] == 50
    assert weighed_ranges(frame.where("k is null"), "k", F.lit(1), 10) == ([], [], 7)
    assert weighed_ranges(frame.limit(0), "k", F.lit(1), 10) == ([], [], 0)
