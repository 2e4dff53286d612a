"""Head, tail and two-sided samples of log files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.keys import sample_hash
from logprism.functions.text import is_blank
from logprism.sources.files import FILE, file_stats, kept_blocks, line_blocks, number_lines

SAMPLE_LINES = 50
# A table of so many blocks or files may be sent to all executors, by way of the driver. Spark judges by bytes on
# disk, and paths are packed so well that a table under its limit can be too much for a driver.
FEW_BLOCKS = 100_000

# The markers around the two halves.
BEGIN_HEAD, END_HEAD = "--- BEGIN HEAD ---\n", "--- END HEAD ---\n\n"
BEGIN_TAIL, END_TAIL = "--- BEGIN TAIL ---\n", "--- END TAIL ---\n"


def _head(head: Column, tail: Column) -> Column:
    return head


def _tail(head: Column, tail: Column) -> Column:
    return tail


def _both(head: Column, tail: Column) -> Column:
    return F.concat(F.lit(BEGIN_HEAD), head, F.lit(END_HEAD), F.lit(BEGIN_TAIL), tail, F.lit(END_TAIL))


# Mode name -> (halves to take, content from the halves). Add a mode to extend.
MODES: dict[str, tuple[tuple[str, ...], Callable[[Column, Column], Column]]] = {
    "first": (("head",), _head),
    "last": (("tail",), _tail),
    "both": (("head", "tail"), _both),
}


def parse_mode(name: str) -> str:
    mode = name.strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown sampling mode {name!r}; one of {', '.join(MODES)}")
    return mode


def edge_texts(
    lines: DataFrame, mode: str = "both", n: int = SAMPLE_LINES, limits: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """``target_id, path, head, tail, head_rows``: text of the first and last lines of each file.

    ``limits`` (``target_id, path, sample_line_count``) replaces ``n`` for a file where
    its number is not null. Lines are counted per block first; only blocks that touch
    an asked end are then kept, so no long file is moved or sorted. What is put
    together per file is its number of lines an end. ``blocks`` are those of the lines,
    where they are known.
    """
    halves, _ = MODES[parse_mode(mode)]
    many = blocks is not None and blocks.count() > FEW_BLOCKS
    blocks = line_blocks(lines) if blocks is None else blocks
    if limits is not None:
        blocks = blocks.join(limits.select(*FILE, "sample_line_count"), FILE, "left")
        blocks = blocks.withColumn("n", F.coalesce("sample_line_count", F.lit(n)))
    else:
        blocks = blocks.withColumn("n", F.lit(n))
    number, rows = F.col("line_no"), F.col("line_rows")
    touches = {"head": F.col("before") < F.col("n"), "tail": F.col("before") + F.col("rows") > rows - F.col("n")}
    inside = {"head": number <= F.col("n"), "tail": number > rows - F.col("n")}
    edges = blocks.where(reduce(or_, [touches[h] for h in halves]))
    files = edges.select(*FILE, "n", "line_rows").distinct()
    if many:
        edges, files = edges.hint("merge"), files.hint("merge")
    kept = number_lines(lines, edges).join(files, FILE).where(reduce(or_, [inside[h] for h in halves]))

    def text(half: str) -> Column:
        wanted = inside[half] if half in halves else F.lit(False)
        found = F.array_sort(F.collect_list(F.when(wanted, F.struct("line_no", "value"))))
        return F.array_join(F.transform(found, lambda r: F.concat(r.value, F.lit("\n"))), "")

    return kept.groupBy(*FILE).agg(
        text("head").alias("head"),
        text("tail").alias("tail"),
        F.count_if(inside["head"]).alias("head_rows"),
    )


def sample_lines(
    lines: DataFrame, mode: str = "both", n: int = SAMPLE_LINES, limits: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """One row per file with lines: ``target_id, path, sample_content, line_count, file_size``.

    A last line without line break keeps lacking it, wherever it ends up. A number of 0
    lines gives empty ends. A file of which only a part was read has neither content nor
    line count. The lines are read twice, the first time now, to count them.
    """
    _, content = MODES[parse_mode(mode)]
    none = F.lit("")
    blocks = kept_blocks(lines) if blocks is None else blocks
    joined = file_stats(lines, blocks).join(edge_texts(lines, mode, n, limits, blocks), FILE, "left")
    unbroken = F.col("unterminated")

    def cut_if(condition: Column, name: str) -> Column:
        text = F.coalesce(name, none)
        shorter = F.substr(text, F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(0)))
        return F.when(condition, shorter).otherwise(text)

    head = cut_if(unbroken & (F.col("head_rows") == F.col("line_rows")), "head")
    tail = cut_if(unbroken, "tail")
    whole = F.when(~F.col("short"), content(head, tail))
    return joined.select(*FILE, whole.alias("sample_content"), "line_count", "file_size")


def _draft(status: Column, content: Column, mode: str, error: Column, *columns) -> list[Column]:
    return [
        "target_id",
        "source_file",
        content.alias("sample_content"),
        "host",
        F.col("source_file").alias("path"),
        F.lit(mode).alias("sampling_mode"),
        *columns,
        status.alias("processing_status"),
        error.cast("string").alias("error_details"),
    ]


# What a file that has bytes but gave no lines, or only a part of them, is reported with.
NOT_READ = "log file could not be read"


def sample_files(
    files: DataFrame, lines: DataFrame, mode: str = "both", n: int = SAMPLE_LINES
) -> DataFrame:
    """Sample drafts of discovered files, with their status.

    ``files`` is ``target_id, host, path, size``; ``sample_line_count`` replaces ``n`` for
    a file where it is set, and ``read_error`` tells a failure known beforehand. A file
    with bytes that gave no lines, or fewer than its bytes, failed too, and so did one of
    which ``lines`` (of :func:`logprism.sources.files.read_lines`) has an error. Its line count, where known, stays. Files
    without lines have no row in ``lines`` and still give a draft.
    """
    mode = parse_mode(mode)
    _, content_of = MODES[mode]
    for name, kind in (("read_error", "string"), ("sample_line_count", "bigint")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    files = files.dropDuplicates(FILE)  # nested directories may both list a file
    limits, blocks = files.where("sample_line_count is not null"), kept_blocks(lines)
    if "error" in lines.columns:  # the reader tells which files it could not read
        failed = blocks.where("failed").select(*FILE).distinct().withColumn("_failed", F.lit(NOT_READ))
        files = files.join(failed, FILE, "left").withColumn("read_error", F.coalesce("read_error", "_failed")).drop("_failed")
        lines, blocks = lines.where("error IS NULL").drop("error"), blocks.where("rows > 0")
    sampled = sample_lines(lines, mode, n, limits, blocks).withColumnRenamed("file_size", "_scanned")
    rows = files.join(sampled, FILE, "left").withColumnRenamed("path", "source_file")
    unread = ((F.col("size") > 0) | F.col("_scanned").isNotNull()) & F.col("sample_content").isNull()
    error = F.coalesce("read_error", F.when(unread, F.lit(NOT_READ)))
    rows = rows.withColumn("read_error", error)
    failed = F.col("read_error").isNotNull()
    empty_file = content_of(F.lit(""), F.lit(""))
    content = F.when(failed, F.lit("")).otherwise(F.coalesce(F.col("sample_content"), empty_file))
    return rows.withColumn("sample_content", content).select(
        *_draft(
            F.when(failed, F.lit("error"))
            .when((F.col("size") == 0) | is_blank(F.col("sample_content")), F.lit("empty"))
            .otherwise(F.lit("stored")),
            F.col("sample_content"),
            mode,
            F.col("read_error"),
            F.coalesce("line_count", F.when(~failed, F.lit(0))).alias("line_count"),
            F.col("size").alias("file_size_bytes"),
        )
    )


# What the rows for directories and targets without files say.
TARGET_ROW = "__target__"
NO_DIRECTORY = "remote directory does not exist"
NO_FILES = "no matching files found"


def directory_outcomes(
    targets: DataFrame, directories: DataFrame, files: DataFrame, mode: str = "both"
) -> DataFrame:
    """Drafts that say why a directory, or a whole target, gave no files.

    ``targets``: ``target_id, host, log_paths, connect_error``. ``directories``:
    ``target_id, directory, list_error`` for the directories that exist. ``files``:
    discovered ``target_id, directory``.
    """
    mode = parse_mode(mode)
    none = F.lit(None).cast("bigint")
    sizes = (none.alias("line_count"), none.alias("file_size_bytes"))
    unreachable = targets.where(F.col("connect_error").isNotNull()).select(
        "target_id", "host", F.lit(TARGET_ROW).alias("source_file"), F.col("connect_error").alias("error")
    )
    asked = targets.where(F.col("connect_error").isNull()).select(
        "target_id", "host", F.explode("log_paths").alias("directory")
    )
    known = directories.select("target_id", "directory", "list_error", F.lit(True).alias("exists"))
    counted = files.groupBy("target_id", "directory").agg(F.count("*").alias("files"))
    seen = asked.join(known, ["target_id", "directory"], "left").join(
        counted, ["target_id", "directory"], "left"
    )
    status = (
        F.when(F.col("exists").isNull(), F.lit("missing_directory"))
        .when(F.col("list_error").isNotNull(), F.lit("error"))
        .when(F.col("files").isNull(), F.lit("no_files_found"))
    )
    error = (
        F.when(F.col("exists").isNull(), F.lit(NO_DIRECTORY))
        .when(F.col("list_error").isNotNull(), F.col("list_error"))
        .otherwise(F.lit(NO_FILES))
    )
    barren = seen.withColumnRenamed("directory", "source_file").where(status.isNotNull())
    return unreachable.select(
        *_draft(F.lit("error"), F.lit(""), mode, F.col("error"), *sizes)
    ).unionByName(barren.select(*_draft(status, F.lit(""), mode, error, *sizes)))


def to_samples(drafts: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """Give drafts their time and content key."""
    stamp = F.current_timestamp() if timestamp is None else timestamp
    return drafts.withColumn("timestamp", stamp).withColumn("sample_hash", sample_hash())
