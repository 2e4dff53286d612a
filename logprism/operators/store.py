"""Sample and metadata tables: deduplication, upserts, purges, work lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from logprism.operators.grouping import first_per_group
from logprism.sources.shared import shared_folder

KEY = "sample_hash"


def _not_stored(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key the store lacks.

    The store is first reduced to the keys that matter. Spark broadcasts ``keys`` for
    that when they are few, and then the store's keys are not shuffled; an anti join
    alone could only broadcast the store.
    """
    known = store.select(KEY).join(keys.select(KEY), KEY, "left_semi")
    return keys.join(known, KEY, "left_anti")


def dedup_samples(incoming: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Rows to insert: the first delivery of each key that the store lacks.

    The cut to one row per key is made in every task before the shuffle, so a third
    of all rows may be copies of one sample. Against the store only keys are compared;
    texts of known samples, usually most of a delivery, are not moved at all.
    """
    if store is not None:
        unknown = _not_stored(incoming.select(KEY).distinct(), store)
        incoming = incoming.join(unknown, KEY, "left_semi")
    return first_deliveries(incoming)


def first_deliveries(incoming: DataFrame) -> DataFrame:
    """The first delivery of each key."""
    order = [F.col("timestamp"), F.col("source_file")]
    if "delivery_id" in incoming.columns:
        order.append(F.col("delivery_id"))
    return first_per_group(incoming, [KEY], order, 1).drop("rank")


def store_outcomes(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Add ``outcome`` to every delivery: ``inserted`` for one of each new key, else ``duplicate``.

    Winners are found by a combining aggregate and joined back by row, so the copies of
    one sample are spread over all tasks. Deliveries that agree in all that orders them
    still have one winner. The numbers of rows are written to the shared folder with them,
    as a task that runs again may number its rows otherwise.
    """
    path = shared_folder(incoming.sparkSession, f"outcomes-{uuid.uuid4().hex}")
    incoming.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    numbered = incoming.sparkSession.read.parquet(path)
    order = ["timestamp", "source_file", *(["delivery_id"] if "delivery_id" in incoming.columns else []), "_row"]
    winners = numbered.groupBy(KEY).agg(F.min(F.struct(*order)).alias("w")).select(KEY, F.col("w._row").alias("_row"))
    winners = _not_stored(winners, store).select("_row", F.lit(True).alias("_won"))
    outcome = F.when(F.col("_won"), "inserted").otherwise("duplicate")
    return numbered.join(winners, "_row", "left").withColumn("outcome", outcome).drop("_won", "_row")


def upsert(stored: DataFrame, incoming: DataFrame, newest: list[Column], key: str = KEY) -> DataFrame:
    """Replace rows of ``stored`` by ``incoming`` ones of the same key; add the others.

    ``newest`` orders incoming rows of one key, the one to keep first. Stored rows
    meet only the incoming keys, which Spark broadcasts when they are few.
    """
    latest = first_per_group(incoming, [key], newest, 1).drop("rank")
    return stored.join(latest.select(key), key, "left_anti").unionByName(latest)


def update_status(metadata: DataFrame, updates: DataFrame) -> DataFrame:
    """Set ``classification_status`` from ``updates`` (``sample_hash, new_status``, one
    row per key); keys that are not there change nothing."""
    return (
        metadata.join(updates.select(KEY, "new_status"), KEY, "left")
        .withColumn(
            "classification_status", F.coalesce("new_status", "classification_status")
        )
        .select(*metadata.columns)
    )


def purge_stale(metadata: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, count)``: rows of the current version, and one row ``deleted``. Rows
    without a version are stale."""
    current = F.col("preprocessing_version").eqNullSafe(version)
    return metadata.where(current), metadata.agg(F.count_if(~current).alias("deleted"))


def unprocessed_samples(
    samples: DataFrame, metadata: DataFrame, limit: int | None = None
) -> DataFrame:
    """Samples of any status without metadata; with ``limit``, the newest of them, newest first.

    Without a limit one anti join does. With one, samples are found by key and time
    alone, and the texts come in at the end. A key counts once, with its newest time.
    """
    if limit is None:
        return samples.join(metadata.select(KEY), KEY, "left_anti")
    missing = samples.select(KEY, "timestamp").join(metadata.select(KEY), KEY, "left_anti")
    newest = missing.groupBy(KEY).agg(F.max("timestamp").alias("timestamp"))
    newest = newest.orderBy(F.desc("timestamp"), KEY).limit(limit)
    found = samples.join(newest, [KEY, "timestamp"], "left_semi")
    return found.orderBy(F.desc("timestamp"), KEY).limit(limit)


def append_samples(samples: DataFrame, path: str) -> None:
    """Append to the sample table, one folder per target."""
    samples.write.mode("append").partitionBy("target_id").parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Write a whole table, such as the result of an upsert, to a new folder."""
    rows.write.mode("errorifexists").parquet(path)
