"""Line dedup: three-line windows that occurred before lose their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.llm.storage import stage

SPAN = 3


def _windows(lines: Column) -> Column:
    """Position and two hashes of every window of three lines that are not all blank."""
    hashed = F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.hash(x).alias("b"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("text")))
    starts = F.when(F.size(lines) >= SPAN, F.sequence(F.lit(0), F.size(lines) - SPAN)).otherwise(F.array().cast("array<int>"))

    def window(hashes: Column, at: Column) -> Column:
        three = [hashes[at + i] for i in range(SPAN)]
        return F.struct(
            at.alias("at"), F.xxhash64(*[x["a"] for x in three]).alias("a"), F.hash(*[x["b"] for x in three]).alias("b"),
            (three[0]["text"] | three[1]["text"] | three[2]["text"]).alias("text"))

    return F.filter(F.element_at(F.transform(F.array(hashed), lambda h: F.transform(starts, lambda i: window(h, i))), 1),
                    lambda w: w["text"])


def repeated_positions(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text_hash) the sorted starts of its windows that occurred before.

    A window repeats if its three lines, exactly, stand earlier in the corpus: in a
    document with a smaller id (null: last), or before in the same text.
    """
    lines = F.split(F.col("text"), "\n", -1)
    windows = stage(
        docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(_windows(lines)))
        .drop("text"), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at", "text_hash")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = windows.join(first, ["a", "b"]).where(place > F.col("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text`` without repeated passages, ``n_lines``, ``removed_lines``.

    All occurrences of a window of three consecutive lines but the first (by doc_id,
    then position) lose their lines; overlapping windows are merged. Lines are split
    at line feeds and compared exactly. Windows of blank lines do not count. Texts of
    fewer than three lines and null texts stay as they are; a text that loses all its
    lines becomes empty. Equal rows of one doc_id both count as the first.
    """
    starts = repeated_positions(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    joined = rows.join(starts.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash"),
                       F.col("text_hash").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    lines = F.split(F.col("row.text"), "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + SPAN - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.element_at(F.transform(F.array(lines), lambda x: F.transform(kept, lambda i: x[i])), 1), "\n"))
    removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size(covered))
    return joined.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), removed.alias("removed_lines"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text without repeated passages, n_lines, removed_lines."""
    return dedup_lines(docs).select(
        "row.doc_id", "text", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.col("removed_lines").cast("long").alias("removed_lines"))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, row_number() OVER () AS no, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT no, doc_id, text, unnest(range(1, len(l) - 1)) AS pos, l FROM d WHERE len(l) >= 3),
v AS (SELECT no, doc_id, text, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS lines FROM w),
f AS (SELECT * FROM v WHERE regexp_matches(lines, '[^\\x20\\x09-\\x0D]')),
r AS (SELECT no, pos, dense_rank() OVER (PARTITION BY lines ORDER BY doc_id NULLS LAST, pos) AS k FROM f),
c AS (SELECT DISTINCT no, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
x AS (SELECT no, list(pos) AS ats FROM c GROUP BY no)
SELECT doc_id, CASE WHEN ats IS NULL THEN d.text ELSE array_to_string(
  list_filter(l, lambda s, i: NOT list_contains(ats, i)), chr(10)) END AS text,
 len(l)::BIGINT AS n_lines, coalesce(len(ats), 0)::BIGINT AS removed_lines
FROM d LEFT JOIN x ON d.no = x.no
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL"""
