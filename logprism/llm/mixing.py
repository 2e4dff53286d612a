"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logprism.llm.prefix import prefix_sums
from logprism.llm.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1 << 26  # expected copies are counted in these parts, so that sums are exact
MOST = 3
ID_BLOCKS = 64


def text_size(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """One row per source: ``_source_no``, ``source_size``, ``target``.

    Sources in code point order, null last, take the ``weights`` in turn and share the
    sum of all sizes by weight. A target stops at ``most`` times its source's size;
    what exceeds that is shared again by weight among the rest. With sources in order
    of their cap per weight, the share per unit of weight is the largest of the shares
    that result when all sources before a source are capped. The windows run over one
    row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source_no").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        per_source.withColumn("_source_no", number).withColumn("_weight", weight).withColumn("_cap", cap)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap), F.lit(0)))
        .withColumn("_weights_before", F.coalesce(F.sum("_weight").over(by_cap), F.lit(0)))
        .withColumn("_share", (F.sum("source_size").over(everything) - F.col("_capped"))
                    / (F.sum("_weight").over(everything) - F.col("_weights_before")))
    )
    best = F.max("_share").over(everything)
    return shares.select(
        "source", "_source_no", "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_weight") * best).alias("target"),
    )


def size_block(size: Column, doc_id: Column) -> Column:
    """Documents of about a size, cut further by id; orders a source by size, roughly."""
    bits = F.length(F.bin(size))
    spread = F.coalesce(F.pmod(doc_id, F.lit(ID_BLOCKS)), F.lit(ID_BLOCKS))
    eighth = F.when(bits > 4, F.expr("shiftright(size, length(bin(size)) - 4)")).otherwise(size)
    return (bits * 16 + eighth) * (ID_BLOCKS + 1) + spread


def with_copies(sized: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies`` to rows of doc_id, source, size (and a ``row``).

    Within a source, documents stand in order of size; each expects target / source_size
    copies. The running sum of that, plus one offset drawn per source, crosses an
    integer as many times as the document is taken. No document is taken more than
    ``most`` times. The offset comes from the seed and the source's name, so reruns
    agree. Documents of size 0 take part, as do those without an id; those without a
    source are one source. Equal rows may share their copies in any way.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))))
    targets = source_targets(sized, weights, most).select(
        F.col("source").alias("_source"), "_source_no", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT))
        .otherwise(0).cast("long").alias("_expected"),
        F.pmod(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long"), F.lit(UNIT)).alias("_offset"),
    )
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    rows = prefix_sums(
        rows.withColumn("_block", size_block(F.col("size"), F.col("doc_id"))),
        "_source_no", "_block", [F.col("size"), F.col("doc_id").asc_nulls_first()], "_expected", "_sum",
    )
    crossed = F.expr(f"(_sum + _offset + _expected) div {UNIT} - (_sum + _offset) div {UNIT}")
    return rows.withColumn("copies", crossed).drop("_source_no", "_expected", "_offset", "_block", "_sum")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; all columns stay as they are."""
    sized = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), F.struct("*").alias("row"))
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return with_copies(sized, seed).where("copies > 0").select("row", F.explode(times)).select("row.*")


def mixed_sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document what the mix takes of it: doc_id, size, source_size, target, taken."""
    sized = stage(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "sizes")
    return with_copies(sized, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
 row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
c AS (SELECT *, (SUM(source_size) OVER () - coalesce(SUM(3 * source_size) OVER b, 0))::DOUBLE
  / (SUM(weight) OVER () - coalesce(SUM(weight) OVER b, 0))::DOUBLE AS share FROM w
 WINDOW b AS (ORDER BY 3 * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least((3 * source_size)::DOUBLE, weight * MAX(share) OVER ()) AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 67108864)::BIGINT ELSE 0 END AS expected,
 ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::UINTEGER::BIGINT % 67108864 AS shift FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.expected, e.shift,
 coalesce(SUM(expected) OVER (PARTITION BY no ORDER BY len(bin(size)),
  CASE WHEN len(bin(size)) > 4 THEN size >> (len(bin(size)) - 4) ELSE size END,
  CASE WHEN doc_id IS NULL THEN 64 ELSE ((doc_id % 64) + 64) % 64 END, size, doc_id NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before
 FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
 (((before + shift + expected) // 67108864 - (before + shift) // 67108864) * size)::BIGINT AS taken FROM r"""
