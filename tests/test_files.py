"""File scan and sampling against files on disk, cut into many small blocks."""

import bz2
import fnmatch
import gzip
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logprism.operators import sampling
from logprism.sources import files
from logprism.testbed import logfiles

BOTH = "--- BEGIN HEAD ---\n{}--- END HEAD ---\n\n--- BEGIN TAIL ---\n{}--- END TAIL ---\n"


def contents() -> dict[str, str]:
    texts = {
        "/one.log": "only\n",
        "/open.log": "a\nb",
        "/blank.log": "\n \n",
        "/cr.log": "a\r\nb\rc\n",
        "/exact.log": "".join(f"{i}\n" for i in range(7)),
        "/d/b c.log": "blank in\nthe name\n",
        "/d/50%+é%20.log": "signs in the name\n",
    }
    for i in range(20):
        broken = "" if i % 3 == 0 else "\n"
        texts[f"/long{i}.log"] = "\n".join(f"line {n} of {i} é" for n in range(40 * i + 1)) + broken
    files = {("t1", path): text for path, text in texts.items()}
    return files | {("t2", "/one.log"): "the other host's\nfile of that name\n"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs here")
    for (target, path), text in contents().items():
        file = folder / (target + path)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode())
    return str(folder)


@pytest.fixture(scope="module")
def scanned(spark, root):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield files.scan_lines(spark, root)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def raw_lines(text: str) -> list[str]:
    return text.splitlines(keepends=True) if "\r" not in text else [p + "\n" for p in text.split("\n")[:-1]]


def by_file(rows):
    return {(r.target_id, r.path): r for r in rows.collect()}


def test_blocks_are_cut(scanned):
    assert scanned.groupBy("path").agg(F.count_distinct("block_start").alias("n")).agg(F.max("n")).first()[0] > 3


def test_line_numbers(scanned):
    got = {}
    for r in files.number_lines(scanned).orderBy("target_id", "path", "line_no").collect():
        got.setdefault((r.target_id, r.path), []).append((r.line_no, r.value))
    assert got == {f: [(i + 1, x.removesuffix("\n")) for i, x in enumerate(raw_lines(text))] for f, text in contents().items()}


def test_line_counts(scanned):
    got = {f: (r.line_count, r.file_size) for f, r in by_file(files.file_stats(scanned)).items()}
    assert got == {f: (text.count("\n"), len(text.encode())) for f, text in contents().items()}


def test_inventory(spark, root):
    got = {f: r.size for f, r in by_file(files.file_inventory(spark, root)).items()}
    assert got == {f: len(text.encode()) for f, text in contents().items()}


@pytest.mark.parametrize("n", [0, 1, 7, 50, 2000])
def test_samples(scanned, n):
    for mode in ("first", "last", "both"):
        got = by_file(sampling.sample_lines(scanned, mode, n))
        for file, text in contents().items():
            lines = raw_lines(text)
            head, tail = "".join(lines[:n]), "".join(lines[-n:] if n else [])
            want = {"first": head, "last": tail, "both": BOTH.format(head, tail)}[mode]
            assert got[file].sample_content == want, (file, mode)


def test_number_of_lines_per_file(spark, scanned):
    own = spark.createDataFrame([("t1", "/long9.log", 2), ("t1", "/one.log", None)], "target_id string, path string, sample_line_count long")
    got = by_file(sampling.sample_lines(scanned, "last", 4, own))
    for file, text in contents().items():
        assert got[file].sample_content == "".join(raw_lines(text)[-2 if file == ("t1", "/long9.log") else -4:]), file


def test_status(spark, scanned):
    found = spark.createDataFrame(
        [("t1", "h", "/one.log", 5, None, None), ("t2", "h", "/one.log", 5, None, 1), ("t1", "h", "/blank.log", 3, None, None),
         ("t1", "h", "/none.log", 0, None, None), ("t1", "h", "/open.log", 3, "broken pipe", None), ("t1", "h", "/gone.log", 9, None, None),
         ("t1", "h", "/d/b c.log", 9, None, None), ("t1", "h", "/d/b c.log", 9, None, None)],
        "target_id string, host string, path string, size long, read_error string, sample_line_count long",
    )
    for mode, empty in (("first", "empty"), ("both", "stored")):
        drafts = sampling.sample_files(found, scanned, mode)
        assert drafts.count() == 7
        rows = {(r.target_id, r.source_file): r for r in drafts.collect()}
        one, none, gone, cut = (rows["t1", f"/{n}.log"] for n in ("one", "none", "gone", "open"))
        assert one.processing_status == "stored" and one.line_count == 1
        assert rows["t1", "/blank.log"].processing_status == empty
        assert none.processing_status == "empty" and none.line_count == 0
        assert (cut.processing_status, cut.sample_content, cut.error_details, cut.line_count) == ("error", "", "broken pipe", 1)
        assert (gone.processing_status, gone.error_details, gone.line_count) == ("error", sampling.NOT_READ, None)
        assert rows["t1", "/d/b c.log"].processing_status == "stored" and rows["t1", "/d/b c.log"].line_count == 2
        assert "only" not in rows["t2", "/one.log"].sample_content
    assert none.sample_content == BOTH.format("", "")
    assert rows["t2", "/one.log"].sample_content == BOTH.format("the other host's\n", "file of that name\n")


def test_a_damaged_file_fails_the_scan(spark, tmp_path):
    whole = gzip.compress("".join(f"line {i} {i * i}\n" for i in range(50_000)).encode())
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.log.gz").write_bytes(whole[:len(whole) // 2])
    with pytest.raises(Exception, match="(?i)EOF|unexpected end|FAILED_READ_FILE"):
        files.scan_lines(spark, str(tmp_path)).count()


@pytest.mark.parametrize("fault", ["cut", "block gone"])
def test_files_read_in_part_are_errors(spark, tmp_path, fault):
    (tmp_path / "t").mkdir()
    text = "".join(f"line {i}\n" for i in range(1000))
    for name in ("cut", "whole"):
        (tmp_path / "t" / f"{name}.log").write_text(text)
    (tmp_path / "t" / "mark.log").write_bytes(b"\xef\xbb\xbfone\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if fault == "cut" else "3000")
    lines = files.scan_lines(spark, str(tmp_path))  # listed now, read below
    found = spark.createDataFrame([("t", "h", f"/{n}.log", len(text)) for n in ("cut", "whole", "mark")], "target_id string, host string, path string, size long")
    if fault == "cut":
        with (tmp_path / "t" / "cut.log").open("r+") as file:
            file.truncate(1000)
    else:
        lines = lines.where("path <> '/cut.log' or block_start <> 3000")
    rows = {r.source_file: r for r in sampling.sample_files(found, lines, "last").collect()}
    counts = {r.path: r.line_count for r in files.file_stats(lines).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cut = rows["/cut.log"]
    assert (cut.processing_status, cut.error_details, cut.sample_content, cut.line_count) == ("error", sampling.NOT_READ, "", None)
    assert (rows["/whole.log"].processing_status, rows["/whole.log"].line_count) == ("stored", 1000)
    assert (rows["/mark.log"].processing_status, rows["/mark.log"].line_count) == ("stored", 2)
    assert counts["/cut.log"] is None and counts["/whole.log"] == 1000


def test_no_text_is_sorted_or_ranked(spark, scanned):
    sampling_plan = sampling.edge_texts(scanned)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in sampling_plan.splitlines() if "Window" in line and "value" in line.split("windowspecdefinition")[0]]
    assert "Sort [" not in sampling_plan


def test_modes():
    assert sampling.parse_mode(" Both ") == "both"
    with pytest.raises(ValueError):
        sampling.parse_mode("middle")


@pytest.mark.parametrize("pattern", ["*.log", "a?c", "x.[lt]*", "[!a]*", "a+b(1).txt"])
def test_globs(spark, pattern):
    names = ["a.log", "alog", "abc", "x.log", "x.txt", "a+b(1).txt", "b\nq", "x.l"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name for r in frame.where(F.col("name").rlike(files.glob_regex(pattern))).collect()}
    assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}


def test_discovery(spark):
    targets = spark.createDataFrame(
        [("a", "h", ["/d", "/d/e/"], None), ("b", "h", ["/d"], 1)],
        "target_id string, host string, log_paths array<string>, max_files long",
    )
    paths = ["/d/1.log", "/d/2.gz", "/d/e/3.log", "/d/e/f/4.log", "/d/e/f/g/5.log", "/dd/6.log"]
    rows = [(t, p, 1) for t in "ab" for p in paths]
    inventory = spark.createDataFrame(rows, "target_id string, path string, size long")

    def found(**options):
        frame = files.discover_files(targets, inventory, **options)
        return sorted((r.target_id, r.directory, r.path) for r in frame.collect())

    below_d = ["/d/1.log", "/d/e/3.log", "/d/e/f/4.log", "/d/e/f/g/5.log"]
    below_e = ["/d/e/3.log", "/d/e/f/4.log", "/d/e/f/g/5.log"]
    assert found(max_depth=0) == []
    assert found() == [("a", "/d", p) for p in below_d] + [("a", "/d/e/", p) for p in below_e] + [("b", "/d", "/d/1.log")]
    assert found(max_files=2, patterns=[], max_depth=1) == [
        ("a", "/d", "/d/1.log"), ("a", "/d", "/d/2.gz"), ("a", "/d/e/", "/d/e/3.log"), ("b", "/d", "/d/1.log"),
    ]


def test_tree_has_empty_files_directories_and_errors(spark, tmp_path):
    for name, text in {"t1/a/x y.log": "one\n", "t1/a/b/none.log": "", "t2/z.log": "22"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "t2" / "hollow").mkdir()
    (tmp_path / "t2" / "lost.log").symlink_to(tmp_path / "nowhere")
    got = {(r.target_id, r.path): (r.kind, r.size, r.error) for r in files.list_tree(spark, str(tmp_path)).collect()}
    assert got == {("t1", ""): ("directory", None, None), ("t2", ""): ("directory", None, None), ("t1", "/a"): ("directory", None, None), ("t1", "/a/b"): ("directory", None, None),
                   ("t1", "/a/x y.log"): ("file", 4, None), ("t1", "/a/b/none.log"): ("file", 0, None), ("t2", "/z.log"): ("file", 2, None),
                   ("t2", "/hollow"): ("directory", None, None)}
    (row,) = files.list_tree(spark, str(tmp_path / "absent")).collect()
    assert row.target_id is None and row.kind == "directory" and "absent" in row.error


@pytest.mark.parametrize("size", [1, 2, 5, 7, 40, 1000])
def test_every_line_is_in_one_range(monkeypatch, size):
    monkeypatch.setattr(files, "CHUNK", 3)
    for text in (b"", b"\n", b"a", b"a\n", b"ab\n\ncd\n", b"\n\nlong line here\nx", b"one two three four\nfive", b"x" * 30 + b"\n" + b"y" * 9):
        got = []
        for start in range(0, max(len(text), 1), size):
            got += [x for lines in files.range_lines(pa.BufferReader(text), start, min(len(text), start + size)) for x in lines]
        assert got == (text.split(b"\n")[:-1] if text.endswith(b"\n") else text.split(b"\n") if text else []), (text, size)


def test_ranges_give_the_lines_of_the_scan(spark, root):
    size = 3000
    listed = files.list_tree(spark, root).where("kind = 'file'")
    lines = files.read_lines(listed, root, size)
    assert lines.where("error is not null").isEmpty()
    got = {}
    for r in files.number_lines(lines.drop("error")).orderBy("target_id", "path", "line_no").collect():
        got.setdefault((r.target_id, r.path), []).append((r.line_no, r.value))
    assert got == {f: [(i + 1, x.removesuffix("\n")) for i, x in enumerate(raw_lines(text))] for f, text in contents().items()}


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    texts = {"whole.log": b"a\nb\n", "gone.log": b"x\n", "cut.log": b"line\n" * 100, "grown.log": b"p\nq", "wide.log": b"\xff\xfe\n", "none.log": b"", "mark.log": b"\xef\xbb\xbfm\n"}
    texts["good.txt.gz"] = gzip.compress(b"z\n" * 50)
    texts["bad.txt.gz"] = gzip.compress(bytes(range(256)) * 3000)[:-400]
    (tmp_path / "t").mkdir()
    for name, data in texts.items():
        (tmp_path / "t" / name).write_bytes(data)
    rows = files.list_tree(spark, str(tmp_path)).where("kind = 'file'").withColumn("host", F.lit("h")).drop("error", "kind").collect()
    rows.append(("t", "/lost.log", None, "h"))
    listed = spark.createDataFrame(rows, "target_id string, path string, size long, host string")
    (tmp_path / "t" / "gone.log").unlink()
    (tmp_path / "t" / "cut.log").write_bytes(b"line\n" * 50)
    (tmp_path / "t" / "grown.log").write_bytes(b"p\nq and more\nnew\n")
    lines = files.read_lines(listed, str(tmp_path), 100)
    got = {r.source_file: r for r in sampling.sample_files(listed, lines, "first").collect()}
    status = {name: r.processing_status for name, r in got.items()}
    assert status == {"/whole.log": "stored", "/gone.log": "error", "/cut.log": "error", "/grown.log": "stored", "/wide.log": "stored", "/none.log": "empty",
                      "/mark.log": "stored", "/good.txt.gz": "stored", "/bad.txt.gz": "error", "/lost.log": "error"}
    assert got["/whole.log"].sample_content == "a\nb\n" and got["/mark.log"].sample_content == "m\n" and got["/cut.log"].error_details == sampling.NOT_READ
    assert got["/grown.log"].sample_content.startswith("p\nq and more") and "new" not in got["/grown.log"].sample_content


def test_the_driver_lists_no_files_and_a_sample_reads_them_twice(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(5):
        (tmp_path / "t" / f"{i}.log").write_text(f"{i}\n")
    scan = files.scan_lines(spark, str(tmp_path))
    assert scan.inputFiles() == [] or not any(".log" in x for x in scan.inputFiles())
    listed = files.list_tree(spark, str(tmp_path)).where("kind = 'file'").withColumn("host", F.lit("h")).drop("kind", "error")
    for lines in (scan, files.read_lines(listed, str(tmp_path))):
        # The first time was to count them, before the plan was made.
        assert sampling.sample_files(listed, lines, "both")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_the_scan_reads_what_sparks_own_does(spark, tmp_path):
    packed = {"a.log.gz": gzip.compress(b"g\n" * 30) + gzip.compress(b"h"), "a.log.bz2": bz2.compress(b"b\n\nc"), "a.log.deflate": zlib.compress(b"d\ne\n")}
    texts = {"a.log": b"\xef\xbb\xbfm\nn", "_b/c.log": b"hidden\n", ".d.log": b"hidden\n", "_e=1/f.log": b"f\n", "g._COPYING_": b"hidden\n", "h[1] {x}*.log": b"i\n", "none.log": b""}
    for name, data in {**packed, **texts}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(data)
    (tmp_path / "t" / "h[1] {x}*.log.deflate").write_bytes(zlib.compress(b"k"))
    own = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path), lineSep="\n").select(F.url_decode("_metadata.file_name").alias("n"), "value")
    got = files.scan_lines(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("n"), "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
    with pytest.raises(OSError):
        files.scan_lines(spark, str(tmp_path / "absent"))


def test_removing_a_file_twice_leaves_it_gone(spark, tmp_path):
    rows = spark.createDataFrame([("t", "/a.log", "x\n"), ("t", "/b.log", "y\n")], "target_id string, path string, text string")
    root = logfiles.write_files(spark, rows, f"file://{tmp_path}")
    gone = rows.where("path = '/a.log'")
    logfiles.remove_files(gone.unionAll(gone), root)
    logfiles.remove_files(gone, root)
    assert [x.name for x in (tmp_path / "t").iterdir()] == ["b.log"]


@pytest.mark.parametrize("few", [0, 100_000])
def test_many_blocks_are_not_broadcast(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW_BLOCKS", few)
    (tmp_path / "t").mkdir()
    for i in range(3):
        (tmp_path / "t" / f"{i}.log").write_text("".join(f"{n}\n" for n in range(i + 5)))
    scan = files.scan_lines(spark, str(tmp_path))
    got = sampling.edge_texts(scan, "last", 2, blocks=files.kept_blocks(scan))
    assert sorted(r.tail for r in got.collect()) == ["3\n4\n", "4\n5\n", "5\n6\n"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=merge" in plan) == (few == 0)
