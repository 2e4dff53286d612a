"""Ingest of samples and log files as streams: once each, profiled on arrival."""

from __future__ import annotations

import contextlib
import logging
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from logprism.operators.classify import CLASSIFY_SCORE, classify_gate
from logprism.operators.store import KEY, first_deliveries, purge_stale, update_status, upsert
from logprism.plans.profile import profile
from logprism.schemas import SAMPLE, SAMPLE_METADATA
from logprism.streaming.versions import Conflict, Versions

POLL_INTERVAL = "300 seconds"
BUCKET_CHARS = 2  # of a hexadecimal hash of the key: 256 folders
log = logging.getLogger(__name__)


def read_deliveries(
    spark: SparkSession, path: str, schema: StructType | str = SAMPLE, *, files_per_cycle: int = 1000, **options
) -> DataFrame:
    """Parquet files that arrive in a folder, a bounded number per cycle."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_cycle)
    return reader.options(**options).parquet(path)


def read_log_files(spark: SparkSession, path: str, *, files_per_cycle: int = 1000, **options) -> DataFrame:
    """Whole text files that arrive in a folder: ``file, file_size, modified, content``.

    A file is taken in once, when it appears; rotate logs into the folder when closed.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_cycle).option("recursiveFileLookup", "true")
    files = reader.options(**options).text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("content"),
    )


def drop_repeats(deliveries: DataFrame) -> DataFrame:
    """The first delivery of each key, however late: none is dropped for its time.

    The state holds every key seen. It is split by key; set
    ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider so that it
    lives on disk. :func:`ingest` needs no such state, it asks its store.
    """
    return deliveries.dropDuplicates([KEY])


SIGHTING = "sample_hash string, timestamp timestamp"
SCHEMAS = {"samples": SAMPLE, "metadata": SAMPLE_METADATA, "keys": "sample_hash string", "sightings": SIGHTING}
BUCKETED = ("metadata", "keys")
Change = Callable[[DataFrame], DataFrame]


class SampleStore:
    """Samples, their keys and metadata: tables that streams and batches add to.

    A table is a list of parts, folders that are written once. Which parts count is said
    by versions of the store (:class:`Versions`): a batch or a merge writes its parts and
    then the next version, so it counts whole or not at all. If another writer was first,
    it starts again from that version; so two streams cannot both insert a key. A batch
    that counts is not added again.

    Keys and metadata are cut into folders by a hash of the key. A batch reads the key
    folders of its own keys, and a merge rewrites the metadata folders of its keys.
    ``compact`` joins parts and deletes those that no longer count.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_chars: int = BUCKET_CHARS):
        self.spark, self.path, self.bucket_chars = spark, path.rstrip("/"), bucket_chars
        self.versions = Versions(spark, f"{self.path}/versions")
        if not self.versions.numbers():
            with contextlib.suppress(Conflict):
                self.versions.commit(-1, {"tables": {name: [] for name in SCHEMAS}, "done": {}, "retired": []})

    def _bucket(self) -> Column:
        return F.substring(F.md5(KEY), 1, self.bucket_chars)

    def _buckets(self, rows: DataFrame) -> list[str]:
        """Names of the folders that rows belong to: at most 16 ** bucket_chars."""
        return sorted(r[0] for r in rows.where(F.col(KEY).isNotNull()).select(self._bucket()).distinct().collect())

    def _paths(self, state: dict, table: str, buckets: list[str] | None = None) -> list[str]:
        paths = []
        for part in state["tables"][table]:
            if part["buckets"] is None or (buckets is None and not part["cut"]):
                paths.append(part["path"])
            else:
                wanted = part["buckets"] if buckets is None else sorted(set(buckets) & set(part["buckets"]))
                paths += [f"{part['path']}/bucket={b}" for b in wanted]
        return paths

    def _rows(self, table: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, table: str) -> DataFrame:
        return self._rows(table, self._paths(self.versions.latest()[1], table))

    def arrived(self, stream: str) -> DataFrame:
        """The deliveries of a stream's last batch."""
        return self.spark.read.schema(SAMPLE).parquet(f"{self.path}/incoming/stream={stream}")

    def last_batch(self, stream: str) -> int:
        """Number of the last batch of a stream that counts; -1 before the first."""
        return self.versions.latest()[1]["done"].get(stream, {"batch": -1})["batch"]

    def _write(self, rows: DataFrame, table: str) -> dict:
        """A new part of a table with these rows; it does not count yet."""
        path = f"{self.path}/{table}/{uuid.uuid4().hex}"
        if table not in BUCKETED:
            rows.write.parquet(path)
            return {"path": path, "buckets": None, "cut": False}
        cut = rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", KEY)
        cut.write.partitionBy("bucket").parquet(path)
        return {"path": path, "buckets": self._buckets(self._rows(table, [path])), "cut": False}

    def _change(self, make: Callable[[dict], Any]) -> Any:
        """Commit what ``make`` does to the newest state; again from the start if another writer was first."""
        while True:
            version, state = self.versions.latest()
            result = make(state)
            try:
                self.versions.commit(version, state)
            except Conflict:
                log.info("another writer was first, starting again")
            else:
                return result

    def add_batch(self, deliveries: DataFrame, stream: str, batch: int) -> DataFrame:
        """Add the samples of a batch that the store lacks, and their profiles; returns the new samples.

        The batch is written once and read from there, whatever its source costs; the
        next batch of the stream takes its place. Batches of a stream have rising numbers;
        one that was added before, or whose successor was, changes nothing and returns
        what it had inserted (nothing, if it was not the stream's last). A batch without
        rows counts, but adds no parts.
        """
        done = self.versions.latest()[1]["done"].get(stream)
        if done is not None and batch <= done["batch"]:
            return self._rows("samples", [done["samples"]] if batch == done["batch"] and done["samples"] else [])
        columns = [name.split()[0] for name in SAMPLE.split(", ")]
        deliveries.select(*columns).write.mode("overwrite").parquet(f"{self.path}/incoming/stream={stream}")
        arrived = self.arrived(stream)
        if arrived.isEmpty():
            self._change(lambda state: state["done"].update({stream: {"batch": batch, "samples": None}}))
            return self._rows("samples", [])
        buckets = self._buckets(arrived)
        sightings = self._write(arrived.groupBy(KEY).agg(F.min("timestamp").alias("timestamp")), "sightings")

        def add(state: dict) -> str:
            known = self._rows("keys", self._paths(state, "keys", buckets))
            known = known.join(arrived.select(KEY).distinct(), KEY, "left_semi")
            samples = self._write(first_deliveries(arrived.join(known, KEY, "left_anti")), "samples")
            inserted = self._rows("samples", [samples["path"]])
            new = {"samples": samples, "sightings": sightings, "metadata": self._write(profile(inserted), "metadata"), "keys": self._write(inserted.select(KEY), "keys")}
            for table, part in new.items():
                state["tables"][table].append(part)
            state["done"][stream] = {"batch": batch, "samples": samples["path"]}
            return samples["path"]

        return self._rows("samples", [self._change(add)])

    def _rewrite(self, state: dict, table: str, change: Change, buckets: list[str] | None = None) -> None:
        """Put new parts in place of some folders of a table, or of all."""
        changed = change(self._rows(table, self._paths(state, table, buckets)))
        new = self._write(changed, table)
        kept = []
        for part in state["tables"][table]:
            left = [] if buckets is None else [b for b in part["buckets"] if b not in buckets]
            if left:
                kept.append({**part, "buckets": left, "cut": part["cut"] or len(left) < len(part["buckets"])})
            else:
                state["retired"].append(part["path"])
        state["tables"][table] = [*kept, new]

    def merge_metadata(self, rows: DataFrame, newest: list[Column]) -> None:
        """Put metadata rows in place of those of the same keys, and add the others (see ``store.upsert``)."""
        columns = [f.name for f in self._rows("metadata", []).schema]
        buckets = self._buckets(rows)
        self._change(lambda state: self._rewrite(state, "metadata", lambda old: upsert(old, rows.select(*columns), newest), buckets))

    def update_status(self, updates: DataFrame) -> None:
        """Set the status of samples from ``sample_hash, new_status``; a key with several gets the first by name."""
        one = updates.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min("new_status").alias("new_status"))
        buckets = self._buckets(one)
        self._change(lambda state: self._rewrite(state, "metadata", lambda old: update_status(old, one), buckets))

    def purge(self, version: str) -> int:
        """Remove the metadata of other profile versions; returns how many rows."""

        def drop(state: dict) -> int:
            stored = self._rows("metadata", self._paths(state, "metadata"))
            _, count = purge_stale(stored, version)
            stale = stored.where(~F.col("preprocessing_version").eqNullSafe(version))
            self._rewrite(state, "metadata", lambda old: purge_stale(old, version)[0], self._buckets(stale))
            return count.first()["deleted"]

        return self._change(drop)

    def compact(self) -> None:
        """Join the parts of keys, metadata and sightings, and delete those that no longer count.

        Rows are copied as they are but for sightings, of which a key's first stays. Readers
        of an older version may lose its files; run it between their queries.
        """

        def join(state: dict) -> list[str]:
            self._rewrite(state, "keys", lambda old: old)
            self._rewrite(state, "metadata", lambda old: old)
            self._rewrite(state, "sightings", lambda old: old.groupBy(KEY).agg(F.min("timestamp").alias("timestamp")))
            retired, state["retired"] = state["retired"], []
            return retired

        self.versions.remove(self._change(join))
        self.versions.forget()

    def decisions(self, *, max_per_cycle: int, cycle: Column, threshold: float = CLASSIFY_SCORE) -> DataFrame:
        """``sample_hash, cycle, decision`` of all samples.

        A sample arrives with the earliest time of its deliveries, and ``cycle`` is made
        from that ``timestamp``; so decisions do not depend on how batches were cut.
        """
        seen = self.read("sightings").groupBy(KEY).agg(F.min("timestamp").alias("timestamp"))
        arrivals = self.read("metadata").select(KEY, "agentic_scan", "classification_status").join(
            seen.select(KEY, "timestamp", cycle.alias("cycle")), KEY
        )
        gated = classify_gate(arrivals, max_per_cycle=max_per_cycle, cycle="cycle", threshold=threshold)
        return gated.select(KEY, "cycle", "decision")


def ingest(
    deliveries: DataFrame,
    store: SampleStore,
    checkpoint: str,
    *,
    stream: str,
    once: bool = False,
    interval: str = POLL_INTERVAL,
    failed_batches: str | None = None,
) -> StreamingQuery:
    """Start the cycle: insert new samples and profile them.

    ``stream`` names this stream in the store, which skips batches that it has; a stream
    with a new checkpoint needs a new name. ``once`` takes in what is there and ends; otherwise a cycle starts
    per interval. With ``failed_batches``, a folder, a cycle that fails leaves its
    deliveries and its error there and the stream goes on; without, the stream ends.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        try:
            store.add_batch(batch, stream, batch_id)
        except Exception as error:
            if failed_batches is None:
                raise
            log.exception("cycle %s of %s failed", batch_id, stream)
            kept = batch.withColumn("error", F.lit(f"{type(error).__name__}: {error}"[:2000]))
            kept.write.mode("overwrite").parquet(f"{failed_batches}/stream={stream}/batch={batch_id}")

    writer = deliveries.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
