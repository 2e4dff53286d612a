"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logprism.llm.storage import stage


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id reachable, for every id in links of longs a, b.

    Alternates two steps (large star, small star): every node links its larger, then its
    smaller neighbours to the least of them, which at last leaves stars around the least
    ids. Links are spread by node and combined before each shuffle; the rounds grow with
    the logarithm of the number of nodes, and each is written to the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stage(small.distinct(), "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        last = state
