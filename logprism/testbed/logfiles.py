"""Log files on shared storage, made from the test tables: a folder per target."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from logprism.sources.shared import shared_folder
from logprism.testbed import rules, tables as t


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``target_id, path, text``: a file per document, and the events' logs of two hosts,
    which have the same paths. A log is rotated by the rule of ``tables.log_samples``."""
    documents = t.table(spark, sf_dir, "documents").select(
        F.col("source").alias("target_id"), F.expr(rules.DOCUMENT_FILE).alias("path"), "text"
    )
    host = F.concat(F.lit("log-"), F.expr("CAST(event_id % 2 AS STRING)"))
    path = F.concat(F.lit("/var/log/"), "event_type", F.lit(" "), F.expr(f"CAST({rules.SEGMENT} AS STRING)"), F.lit(".log"))
    events = (
        t.log_lines(spark, sf_dir)
        .groupBy(host.alias("target_id"), path.alias("path"))
        .agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("rows"))
    )
    text = F.array_join(F.transform("rows", lambda r: F.concat(r.line, F.lit("\n"))), "")
    return documents.unionByName(events.select("target_id", "path", text.alias("text")))


def write_log_files(spark: SparkSession, sf_dir: str) -> str:
    """Writes the files and returns their root."""
    return write_files(spark, file_texts(spark, sf_dir).where("text <> ''"))


def remove_files(files: DataFrame, root: str) -> None:
    """Removes files; one that is gone stays so, as a task may run again and a file may be named twice."""
    def remove(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for row in rows:
            with contextlib.suppress(FileNotFoundError):
                store.delete_file(f"{base}/{row.target_id}{row.path}")

    files.foreachPartition(remove)


def write_files(spark: SparkSession, files: DataFrame, root: str | None = None) -> str:
    """Writes ``target_id, path, text`` as files, over older ones of ``root``, and returns their root."""
    root = root or shared_folder(spark, f"logs-{t.run_id()}")

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for row in rows:
            file = f"{base}/{row.target_id}{row.path}"
            store.create_dir(file.rpartition("/")[0], recursive=True)
            with store.open_output_stream(file) as out:
                out.write(row.text.encode())

    files.foreachPartition(write)
    return root
