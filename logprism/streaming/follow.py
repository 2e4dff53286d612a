"""Growing log files: what was added to each since the last cycle becomes samples, once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from logprism.operators.sampling import NOT_READ, SAMPLE_LINES, sample_files, to_samples
from logprism.sources.files import FILE, PACKED, PATTERNS, discover_files, list_tree, read_lines, whole_lines
from logprism.streaming.ingest import POLL_INTERVAL, SampleStore
from logprism.streaming.versions import Versions

PLAN = """target_id string, path string, host string, sample_line_count long, size long, start long, settled boolean,
    missed long, end long, read_error string"""


class LogFollower:
    """Reads on in log files where the last cycle stopped, and adds samples of the new lines to a store.

    A cycle has two steps. Its plan, a table with the bytes ``start`` to ``end`` to take from
    each file, is written whole and then named by the next version; its samples are then added to
    the store as the batch of that number, which counts once. A cycle that was interrupted is
    finished from its plan by the next call, also in another session: a line is taken neither
    twice nor never. So the plans are the state, with one row per file, like the listing.

    * Only whole lines are taken. A last line without its break is taken when the file has
      not grown for a cycle; if it then grows, the rest counts as a line.
    * A file shorter than what was taken of it was cut or replaced, and starts again at 0.
      One replaced by a longer file is not told from one that grew.
    * Compressed files are taken as a whole when they have not grown for a cycle.
    * A file that cannot be read is a sample with status ``error``, and is tried again from
      the same place; repeated errors of a file are one sample, as their key is the same.
    * A file that is not listed keeps its place for ``forget_after`` cycles.

    Two followers of one ``stream`` must not run at once; the second one fails.
    """

    def __init__(
        self,
        store: SampleStore,
        root: str,
        stream: str,
        *,
        mode: str = "both",
        n: int = SAMPLE_LINES,
        patterns: tuple[str, ...] = PATTERNS,
        max_depth: int | None = None,
        forget_after: int = 288,
    ):
        self.store, self.spark, self.root, self.stream = store, store.spark, root, stream
        self.mode, self.n, self.patterns, self.max_depth, self.forget_after = mode, n, patterns, max_depth, forget_after
        self.folder = f"{store.path}/follow/{stream}"
        self.plans = Versions(self.spark, f"{self.folder}/versions")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(PLAN).parquet(path)

    def places(self) -> DataFrame:
        """Up to which byte each file is planned to be taken: ``target_id, path, size, end``."""
        _, state = self.plans.latest()
        rows = self._read(state["plan"]) if state else self.spark.createDataFrame([], PLAN)
        return rows.select(*FILE, "size", "end")

    def _taken(self, state: dict) -> DataFrame:
        """Where the last cycle stopped in each file; of those that it could not read, where it began."""
        if not state:
            return self.spark.createDataFrame([], PLAN).select(*FILE, F.col("end").alias("taken"), F.col("size").alias("known"), "missed")
        failed = self.store.arrived(self.stream).where("processing_status = 'error'")
        failed = failed.select("target_id", F.col("source_file").alias("path"), F.lit(True).alias("failed")).distinct()
        taken = F.when(F.col("failed"), F.col("start")).otherwise(F.col("end"))
        return self._read(state["plan"]).join(failed, FILE, "left").select(*FILE, taken.alias("taken"), F.col("size").alias("known"), "missed")

    def _plan(self, number: int, state: dict, targets: DataFrame) -> tuple[int, dict]:
        listed = list_tree(self.spark, self.root).where("kind = 'file'").select(*FILE, "size")
        files = discover_files(targets, listed, patterns=self.patterns, max_depth=self.max_depth).dropDuplicates(FILE)
        if "sample_line_count" not in files.columns:
            files = files.withColumn("sample_line_count", F.lit(None).cast("long"))
        both = files.drop("directory").join(self._taken(state), FILE, "full")
        settled = F.coalesce(F.col("size") == F.col("known"), F.lit(False))
        packed = F.substring_index(F.lower("path"), ".", -1).isin(*[x[1:] for x in PACKED])
        fresh = (F.col("size") < F.col("taken")) | (packed & (F.col("size") != F.col("taken")))
        rows = both.select(
            *FILE, "host", F.col("sample_line_count").cast("long").alias("sample_line_count"),
            F.col("size").cast("long").alias("size"),
            F.when(fresh, F.lit(0)).otherwise(F.coalesce("taken", F.lit(0))).cast("long").alias("start"),
            settled.alias("settled"),
            F.when(F.col("size").isNull(), F.coalesce("missed", F.lit(0)) + 1).otherwise(F.lit(0)).cast("long").alias("missed"),
        ).where(F.col("missed") <= self.forget_after)
        path = f"{self.folder}/plans/{uuid.uuid4().hex}"
        whole_lines(rows, self.root).write.parquet(path)
        following = {"plan": path, "before": state.get("plan")}
        self.plans.commit(number, following)
        if state.get("before"):
            self.plans.remove([state["before"]])
        self.plans.forget()
        return number + 1, following

    def samples(self, plan: DataFrame, timestamp: Column | None = None) -> DataFrame:
        """Samples of what a plan takes from each file."""
        failed = F.when(F.col("read_error").isNotNull(), F.lit(NOT_READ))
        parts = plan.where("end > start OR read_error IS NOT NULL").select(
            *FILE, "host", "sample_line_count", "start", (F.col("end") - F.col("start")).alias("size"), failed.alias("read_error"))
        lines = read_lines(parts.where("read_error IS NULL"), self.root)
        return to_samples(sample_files(parts, lines, self.mode, self.n), timestamp)

    def cycle(self, targets: DataFrame, timestamp: Column | None = None) -> DataFrame:
        """Take what was added, or finish the cycle that was interrupted; returns the new samples.

        ``targets`` are valid ones (:func:`logprism.sources.targets.validate_targets`).
        """
        number, state = self.plans.latest()
        if number <= self.store.last_batch(self.stream):
            number, state = self._plan(number, state, targets)
        return self.store.add_batch(self.samples(self._read(state["plan"]), timestamp), self.stream, number)


def follow(
    follower: LogFollower, targets: Callable[[], DataFrame], checkpoint: str, *, interval: str = POLL_INTERVAL
) -> StreamingQuery:
    """Start a cycle per interval. ``targets`` is asked before each, so changed targets count from then on.

    The stream is only the clock: what was taken is said by the follower's plans and the
    store, so a new checkpoint loses and repeats nothing. A cycle that fails ends the stream.
    """
    clock = follower.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(lambda *_: follower.cycle(targets()))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
