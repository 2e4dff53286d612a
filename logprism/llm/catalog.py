"""Queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logprism.llm import (
    chat, embedding_dedup, hard_negatives, knn, language_id, lexical_search, line_dedup, mixing, ngram_join, packing, quality, token_files, warc,
)
from logprism.llm.storage import read_columns, ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, report: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return report(read_columns(spark, sf_dir, table, *columns))

    return run


def _on_two(
    table: str, other: str, report: Callable[[DataFrame, DataFrame], DataFrame], columns: tuple[str, ...], others: tuple[str, ...]
) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return report(read_columns(spark, sf_dir, table, *columns), read_columns(spark, sf_dir, other, *others))

    return run


QUERIES: dict[str, Query] = {
    "op1_voronoi_knn": _on("embeddings", knn.knn_report, "vec_id", "embedding"),
    "op2_warc": _on("pages", warc.warc_report, "page_id", "url", "html"),
    "op3_chat_format": lambda spark, sf_dir: chat.chat_digests(
        chat.with_control_chat(spark, read_columns(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))),
    "op4_source_mix": _on("documents", mixing.mixed_sizes, "doc_id", "source", "text"),
    "op5_embedding_dedup": _on("embeddings", embedding_dedup.embedding_report, "vec_id", "embedding", "label"),
    "op6_token_files": _on("documents", token_files.token_report, "doc_id", "text"),
    "op7_ngram_join": _on("documents", ngram_join.ngram_report, "doc_id", "text"),
    "op8_best_fit_packing": _on("documents", packing.packed, "doc_id", "text"),
    "op9_line_dedup": _on("documents", line_dedup.dedup_report, "doc_id", "text"),
    "op10_language_id": _on("documents", language_id.language_report, "doc_id", "text", "lang"),
    "op11_quality_machine": _on_two("documents", "labels", quality.quality_report, ("doc_id", "text", "n_chars"), ("doc_id", "quality")),
    "op12_lexical_search": _on_two("documents", "benchmark", lexical_search.lexical_search, ("doc_id", "text"), ("item_id", "text")),
    "op13_hard_negatives": _on("embeddings", hard_negatives.negatives_report, "vec_id", "embedding", "label"),
}

SQL = {
    "op1_voronoi_knn": knn.KNN_SQL,
    "op2_warc": warc.WARC_SQL,
    "op3_chat_format": chat.CHAT_SQL,
    "op4_source_mix": mixing.MIX_SQL,
    "op5_embedding_dedup": embedding_dedup.EMBEDDING_SQL,
    "op7_ngram_join": ngram_join.NGRAM_SQL,
    "op9_line_dedup": line_dedup.LINE_DEDUP_SQL,
    "op12_lexical_search": lexical_search.SEARCH_SQL,
    "op13_hard_negatives": hard_negatives.NEGATIVES_SQL,
}
