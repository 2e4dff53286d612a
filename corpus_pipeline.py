"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logprism.llm import language_id, line_dedup, mixing, ngram_join, packing
from logprism.llm.storage import scratch, ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject."""
    ship_package(spark)
    return language_id.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that came before; those that lose all their lines go."""
    done = line_dedup.dedup_lines(docs).where("removed_lines = 0 or removed_lines < n_lines")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target weights."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship_package(spark)
    return packing.packed(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # language models and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written, and read by the next."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{number}")
        function(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
