"""Log files: discovery, line scan, line counts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logprism.operators.grouping import first_per_group, hashed_part
from logprism.sources.shared import shared_folder

PATTERNS = ("*.log", "*.out", "*.txt")


def glob_regex(pattern: str) -> str:
    """Java pattern for a shell glob with ``*``, ``?`` and ``[...]``."""
    parts = re.split(r"(\*|\?|\[!?[^\]]+\])", pattern)
    fixed = {"*": ".*", "?": "."}
    out = []
    for part in parts:
        if part in fixed:
            out.append(fixed[part])
        elif part.startswith("[") and part.endswith("]"):
            body = part[1:-1].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", part))
    return "(?s)^" + "".join(out) + r"\z"


# A file is known by its target and its path there: two hosts may both have a /var/log/a.log.
FILE = ["target_id", "path"]


def plain_path(uri: Column, encoded: bool) -> Column:
    """A file's path without the scheme of local files, percent signs resolved if ``encoded``."""
    path = F.regexp_replace(uri, "^file:/+", "/")
    if not encoded:
        return path
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # a plus sign is no blank here


def _located(path: Column, root: str) -> list[Column]:
    """Target and path there of a file at ``<root>/<target>/<path>``."""
    base = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    below = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1)))
    target = F.substring_index(below, "/", 1)
    return [target.alias("target_id"), F.substr(below, F.char_length(target) + 1).alias("path")]


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``target_id, path, size`` of all files below ``root``, which holds a folder per
    target with that host's files. Their bytes are not read.

    Spark's file sources leave out zero-length files; :func:`list_tree` lists them too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(*_located(plain_path(F.col("path"), encoded=False), root), F.col("length").alias("size"))


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, for use inside a task."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


ENTRY = "entry string, kind string, size long, error string"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``target_id, path, kind, size, error`` of all files and directories below ``root``.

    ``kind`` is ``file`` or ``directory``. Empty files and empty directories are listed; a
    directory that cannot be listed has an ``error``, and so has ``root`` itself (with null
    ``target_id``). Links to nowhere are left out. Tasks list the directories of one level
    after the other; each level is written to the shared folder.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        kinds = pa.schema([("entry", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for entry in batch.column(0).to_pylist():
                try:
                    found = store.get_file_info(fs.FileSelector(f"{base}/{entry}".rstrip("/")))
                except OSError as error:
                    yield pa.RecordBatch.from_pylist([{"entry": entry, "kind": "failed", "error": str(error)}], kinds)
                    continue
                rows = [{"entry": f"{entry}/{x.base_name}".lstrip("/"), "kind": "directory" if x.type == fs.FileType.Directory else "file",
                         "size": x.size if x.type == fs.FileType.File else None} for x in found]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    below, levels, folder = spark.createDataFrame([("",)], "entry string"), [], shared_folder(spark, f"listing-{uuid.uuid4().hex}")
    while not below.isEmpty():
        path = f"{folder}/level={len(levels)}"
        spread = below.repartition(spark.sparkContext.defaultParallelism, "entry")  # one directory is listed in one call
        spread.mapInArrow(look, ENTRY).write.parquet(path)
        levels.append(spark.read.schema(ENTRY).parquet(path))
        below = levels[-1].where("kind = 'directory'").select("entry")
    every = reduce(DataFrame.unionAll, levels)
    failed = every.where("kind = 'failed'").select("entry", F.col("error").alias("_error"))
    known = every.where("kind <> 'failed'").unionByName(failed.where("entry = ''").select("entry", F.lit("directory").alias("kind"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("error")))
    target = F.nullif(F.substring_index("entry", "/", 1), F.lit(""))
    return known.join(failed, "entry", "left").select(
        target.alias("target_id"), F.substr("entry", F.char_length(target) + 1).alias("path"), "kind", "size", F.col("_error").alias("error"))


def discover_files(
    targets: DataFrame,
    inventory: DataFrame,
    *,
    patterns: Sequence[str] = PATTERNS,
    max_depth: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Files to sample per target and configured directory.

    ``inventory`` is ``target_id, path, size``. A file counts when it lies at most
    ``max_depth`` levels down (1 is the directory itself; by default any depth counts)
    and its name matches a pattern (no patterns: any name). A directory gives all its
    files; where its target sets ``max_files``, or the argument does, the first ones by
    path. A target's other settings, such as ``sample_line_count``, stay on its files.
    """
    own = [c for c in ("sample_line_count",) if c in targets.columns]
    folders = targets.select(
        "target_id", "host", "max_files", *own, F.explode("log_paths").alias("directory")
    ).withColumn("prefix", F.concat(F.regexp_replace("directory", "/+$", ""), F.lit("/")))
    # Every folder above a file, down to max_depth levels, so that the search below a
    # directory becomes an equality join.
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.size(parts) - 1)
    if max_depth is not None:
        levels = F.filter(levels, lambda k: k >= F.size(parts) - max_depth)
    prefixes = F.transform(
        levels, lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))
    )
    candidates = inventory.where(F.contains("path", F.lit("/")))
    if patterns:
        name = F.substring_index("path", "/", -1)
        any_glob = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
        candidates = candidates.where(name.rlike(any_glob))
    candidates = candidates.withColumn("prefix", F.explode(prefixes))
    found = candidates.join(folders, ["target_id", "prefix"])
    limit = F.coalesce(F.col("max_files"), F.lit(max_files), F.lit(2**62))
    return first_per_group(
        found, ["target_id", "directory"], [F.col("path")], limit, hashed_part("path")
    ).select("target_id", "host", "directory", "path", "size", *own)


def scan_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of text files: ``target_id, path, file_size, block_start, pos, value``.

    ``root`` is as in :func:`file_inventory`. Only ``\\n`` ends a line. ``(block_start,
    pos)`` orders the lines of a file: files are cut into blocks by offset, and a task
    reads a block in order, numbering its lines without gaps. Files are listed when this is
    called, in tasks as :func:`list_tree` does, so the driver holds none of their names; a directory
    that cannot be listed fails the call. A read that fails is tried
    again as Spark tries tasks again, and then fails the query. Files that vanish give no
    more lines; :func:`file_stats` tells which fell short, and
    :func:`logprism.operators.sampling.sample_files` reports them. As in Spark's own text scan,
    names with a dot or an underscore in front are left out.
    """
    tree = list_tree(spark, root)
    if (refused := tree.where("error IS NOT NULL").first()) is not None:
        raise OSError(f"{refused.target_id or root}{refused.path or ''}: {refused.error}")
    hidden = F.rlike(F.concat(F.lit("/"), "target_id", "path"), F.lit(HIDDEN))
    listed = tree.where((F.col("kind") == "file") & (F.col("size") > 0) & ~hidden).drop("kind", "error")
    own = F.rlike("path", F.lit(HADOOP_PACKED))
    range_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = _range_lines(listed.where(~own), root, range_bytes, strict=True).drop("error")
    return reduce(DataFrame.unionByName, [found, *_hadoop_lines(spark, listed.where(own), root)])


# Names that Spark's file sources leave out, as a part of a path.
HIDDEN = r"/(?:\.|_(?!metadata|common_metadata)[^/=]*(?:/|\z))|\._COPYING_(?:/|\z)"
# Names of files that only Hadoop's readers decompress.
HADOOP_PACKED = r"\.(deflate|lz4|snappy)\z"


def _hadoop_lines(spark: SparkSession, files: DataFrame, root: str) -> list[DataFrame]:
    """Lines of files in Hadoop's own formats, by Spark's text scan; nothing if there are none."""
    paths = [f"{root.rstrip('/')}/{r.target_id}{r.path}" for r in files.select(*FILE).toLocalIterator()]
    if not paths:
        return []
    # Said outright, so that no session setting skips the rest of a block.
    reader = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "false")
    text = reader.text([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths], lineSep="\n")
    return [text.select(
        *_located(plain_path(F.col("_metadata.file_path"), encoded=True), root),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )]


RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
LEAST_READ = 1 << 16  # what is asked for at a time of a small file, or of the rest of a range
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
# Names of files that this reader decompresses; they are read as one range.
PACKED = (".gz", ".bz2", ".zst", ".lz4")


def range_lines(file: pa.NativeFile, start: int, end: int | None) -> Iterator[list[bytes]]:
    """Lines that start from ``start`` on and before ``end``, without their breaks; the last may reach beyond."""
    at, rest, skip = max(0, start - 1), [], start > 0
    if at:
        file.seek(at)
    while True:
        data = file.read(CHUNK if end is None else min(CHUNK, max(end - at + 1, LEAST_READ)))
        cut = data.rfind(b"\n") + 1
        if data and not cut:  # a long line goes on
            rest.append(data)
            continue
        part = b"".join([*rest, data[:cut]])
        rest = [data[cut:]] if data else []
        begin, at = at, at + len(part)
        if skip and part:
            first = part.find(b"\n") + 1 or len(part)
            begin, part, skip = begin + first, part[first:], False
        over = end is not None and at >= end
        if over:
            last = part.find(b"\n", max(0, end - 1 - begin)) if end > begin else -1
            part = part[:last + 1] if last >= 0 else part if end > begin else b""
        if part:
            lines = part.split(b"\n")
            if not lines[-1]:
                lines.pop()
            if not begin and lines[0].startswith(b"\xef\xbb\xbf"):
                lines[0] = lines[0][3:]
            yield lines
        if over or not data:
            return


class Part:
    """The bytes of a file from ``start`` on, ``size`` of them, as a file of their own."""

    def __init__(self, file: pa.NativeFile, start: int, size: int | None):
        self.file, self.start, self.end = file, start, None if size is None else start + size
        file.seek(start)

    def seek(self, at: int) -> None:
        self.file.seek(self.start + at)

    def read(self, n: int) -> bytes:
        return self.file.read(n if self.end is None else max(0, min(n, self.end - self.file.tell())))


def break_before(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the last whole line of bytes ``start`` to ``size`` ends; ``start`` if there is none."""
    at = size
    while at > start:
        low = max(start, at - CHUNK)
        file.seek(low)
        cut = file.read(at - low).rfind(b"\n")
        if cut >= 0:
            return low + cut + 1
        at = low
    return start


def whole_lines(files: DataFrame, root: str) -> DataFrame:
    """Add ``end``, up to which a file can be taken, and ``read_error`` to ``target_id, path, size, start, settled, ...``.

    That is the last line break from ``start`` on, or all of the file if it is ``settled``.
    Files in ``PACKED`` are taken when settled. A file that fails, or that a listing did
    not find (null ``size``), stays at its ``start``, and so does one that was cut since.
    """
    names = files.columns

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            ends, errors = [], []
            for file in batch.select(["target_id", "path", "size", "start", "settled"]).to_pylist():
                end, error, path = file["start"], None, f"{base}/{file['target_id']}{file['path']}"
                if file["size"] is not None and file["size"] > end:
                    if file["settled"]:
                        end = file["size"]
                    elif not path.lower().endswith(PACKED):
                        try:
                            with store.open_input_file(path) as data:
                                end = break_before(data, end, file["size"]) if data.size() >= file["size"] else end
                        except (OSError, pa.ArrowException) as failure:
                            error = f"{type(failure).__name__}: {failure}"
                ends.append(end)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64()), pa.array(errors, pa.string())], [*names, "end", "read_error"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(look, f"{own}, end long, read_error string")


def read_lines(files: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of listed files, as of :func:`scan_lines`, with a column ``error``.

    ``files`` is ``target_id, path, size``; with a column ``start``, ``size`` bytes from
    there on are read as if they were a file. Tasks read ranges of bytes. Where a range cannot
    be read (the file is unreadable, vanished, damaged, or shorter than listed), a row with
    an ``error`` and a null ``value`` says so, and the query goes on; lines read before that
    stay. What was added to a file after it was listed is left for the next time, but for
    the rest of its last line (with a ``start`` other than 0, that too). Names in ``PACKED`` are decompressed.
    """
    return _range_lines(files, root, range_bytes, strict=False)


LINE_ROWS = "target_id string, path string, file_size long, block_start long, pos long, value binary, error string"


def _range_lines(files: DataFrame, root: str, range_bytes: int, strict: bool) -> DataFrame:
    """Lines of ranges of listed files, those of many small files in one batch.

    If ``strict``, a read that fails is raised, but a file that has vanished gives nothing
    and one that was cut what is left of it; else all three give a row with an ``error``.
    """
    spark = files.sparkSession
    start = (F.col("start") if "start" in files.columns else F.lit(0)).cast("long").alias("start")
    listed = files.where("size IS NULL OR size > 0").select("target_id", "path", F.col("size").cast("long").alias("size"), start)
    packed = F.substring_index(F.lower("path"), ".", -1).isin(*[x[1:] for x in PACKED])
    last = F.when(packed, F.lit(0)).otherwise(F.coalesce(F.col("size") - 1, F.lit(0)))
    ranges = listed.withColumn("block_start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(range_bytes).cast("long"))))
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // RANGE_BYTES)

    def lines_of(store: fs.FileSystem, file: dict, path: str) -> Iterator[list[bytes]]:
        single = path.lower().endswith(PACKED)
        opened = store.open_input_stream(path) if single else store.open_input_file(path)
        with opened as data:
            if not strict and not single and file["size"] is not None and data.size() < file["start"] + file["size"]:
                raise OSError(f"{data.size()} bytes of {file['start'] + file['size']} are left")
            end = None if single or file["size"] is None else min(file["size"], file["block_start"] + range_bytes)
            part = Part(data, file["start"], file["size"]) if file["start"] else data
            if strict and not single and data.size() <= file["block_start"]:
                return
            yield from range_lines(part, file["block_start"], end)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        names = ["target_id", "path", "file_size", "block_start", "pos", "value", "error"]
        runs: list[tuple[dict, int, int, str | None]] = []  # of lines that follow one another in a file
        values: list[bytes | None] = []

        def rows() -> pa.RecordBatch:
            counts = [n for _, _, n, _ in runs]
            index = pa.array(np.repeat(np.arange(len(runs)), counts))
            each = [pa.array([file[c] for file, *_ in runs], k) for c, k in (("target_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("block_start", pa.int64()))]
            pos = pa.array(np.concatenate([np.arange(first, first + n) for _, first, n, _ in runs]), pa.int64())
            errors = pa.array([error for *_, error in runs], pa.string())
            made = pa.RecordBatch.from_arrays([*[c.take(index) for c in each], pos, pa.array(values, pa.binary()), errors.take(index)], names)
            runs.clear()
            values.clear()
            return made

        for batch in batches:
            size = 0
            for file in batch.to_pylist():
                pos, path = 0, f"{base}/{file['target_id']}{file['path']}"
                try:
                    for lines in lines_of(store, file, path):
                        for i in range(0, len(lines), BATCH_ROWS):
                            part = lines[i:i + BATCH_ROWS]
                            if runs and (len(values) + len(part) > BATCH_ROWS or size > BATCH_BYTES):
                                yield rows()
                                size = 0
                            runs.append((file, pos, len(part), None))
                            values += part
                            size += sum(map(len, part))
                            pos += len(part)
                except (OSError, pa.ArrowException) as error:
                    if not strict:
                        runs.append((file, pos, 1, f"{type(error).__name__}: {error}"))
                        values.append(None)
                    elif not isinstance(error, FileNotFoundError):
                        raise OSError(f"FAILED_READ_FILE {path}: {error}") from error
            if runs:
                yield rows()

    found = ranges.repartition(tasks).mapInArrow(read, LINE_ROWS)
    return found.withColumn("value", F.col("value").cast("string"))


def line_blocks(lines: DataFrame) -> DataFrame:
    """One row per block of a file: ``first_pos, rows, bytes, file_size``, the lines
    ``before`` it and the ``line_rows`` of the whole file. Counted on the map side.

    Where ``lines`` has a column ``error``, its rows of null ``value`` are not lines, and
    ``failed`` tells the blocks that have one.
    """
    failed = [F.max(F.col("error").isNotNull()).alias("failed")] if "error" in lines.columns else []
    counted = lines.groupBy(*FILE, "block_start").agg(
        F.min("pos").alias("first_pos"),
        F.count("value").alias("rows"),
        F.sum(F.octet_length("value").cast("bigint") + 1).alias("bytes"),
        F.max("file_size").alias("file_size"),
        *failed,
    )
    ordered = Window.partitionBy(*FILE).orderBy("block_start")
    return counted.select(
        "*",
        F.coalesce(F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(Window.partitionBy(*FILE)).alias("line_rows"),
    )


def kept_blocks(lines: DataFrame) -> DataFrame:
    """The rows of :func:`line_blocks`, counted now and written to the shared folder.

    What needs them more than once does not read the files again for it.
    """
    spark = lines.sparkSession
    blocks = line_blocks(lines)
    path = shared_folder(spark, f"blocks-{uuid.uuid4().hex}")
    blocks.write.parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def number_lines(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Add ``line_no`` (from 1) within each file; with ``blocks``, only of those blocks.

    No text is sorted: a line's place in its block tells its number.
    """
    placed = (line_blocks(lines) if blocks is None else blocks).select(*FILE, "block_start", "first_pos", "before")
    number = F.col("before") + F.col("pos") - F.col("first_pos") + 1
    return lines.join(placed, [*FILE, "block_start"]).select(*lines.columns, number.alias("line_no"))


# Names of files that Hadoop's readers decompress: their lines do not tell the bytes read.
COMPRESSED = r"\.(gz|bz2|deflate|zst|lz4|snappy)\z"


def file_stats(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Per file ``line_rows``, ``line_count`` (line breaks), ``file_size``, whether the
    last line lacks its break, and whether the lines are ``short`` of the file's bytes.

    A file falls short if it vanished or was cut while it was read. Its ``line_count``
    is null. Spark leaves out a byte order mark, so that 3 bytes less (2 if the last
    line lacks its break) are whole. Compressed files are never found short. ``blocks`` are
    those of the lines, where they are known.
    """
    missing = F.max("file_size") - F.sum("bytes")
    rows = (line_blocks(lines) if blocks is None else blocks).groupBy(*FILE).agg(
        F.max("line_rows").alias("line_rows"),
        F.max("file_size").alias("file_size"),
        F.coalesce(missing == -1, F.lit(False)).alias("unterminated"),
        F.coalesce((missing > 0) & ~missing.isin(2, 3), F.lit(False)).alias("short"),
    )
    rows = rows.withColumn("short", F.col("short") & ~F.rlike(F.lower("path"), F.lit(COMPRESSED)))
    return rows.withColumn("line_count", F.when(~F.col("short"), F.col("line_rows") - F.col("unterminated").cast("bigint")))
