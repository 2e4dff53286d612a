"""Growing log files: every line once, over interruptions, cuts and failures."""

import gzip
import io
import time

import pytest

from logprism.sources.files import break_before
from logprism.streaming.follow import LogFollower, follow
from logprism.streaming.ingest import SampleStore


@pytest.mark.parametrize("text", [b"", b"x", b"a\nb", b"a\n", b"\n\nlong line", b"ab\ncd\nef\n"])
def test_break_before(text, monkeypatch):
    monkeypatch.setattr("logprism.sources.files.CHUNK", 2)
    for size in range(len(text) + 1):
        for start in range(size + 1):
            assert break_before(io.BytesIO(text), start, size) == max(start, text[:size].rfind(b"\n") + 1)


@pytest.fixture
def logs(spark, tmp_path):
    class Logs:
        folder = tmp_path / "hosts" / "web" / "log"
        targets = spark.createDataFrame([("web", "h", None, ["/log"])], "target_id string, host string, max_files long, log_paths array<string>")

        def follower(self, **options):
            return LogFollower(SampleStore(spark, str(tmp_path / "store"), 1), str(tmp_path / "hosts"), "s", mode="last", **options)

        def add(self, name, text):
            with open(self.folder / name, "a") as file:
                file.write(text)

        def cycle(self, **options):
            rows = self.follower(**options).cycle(self.targets).collect()
            return sorted((r.source_file.rpartition("/")[2], r.sample_content, r.processing_status) for r in rows)

    Logs.folder.mkdir(parents=True)
    return Logs()


def test_added_lines_come_once(logs):
    logs.add("a.log", "one\ntwo\nthr")
    logs.add("b.log", "x\n")
    logs.add("none.log", "")
    assert logs.cycle() == [("a.log", "one\ntwo\n", "stored"), ("b.log", "x\n", "stored")]
    logs.add("a.log", "ee\nfour\nfi")
    logs.add("c.log", "new\n")
    assert logs.cycle() == [("a.log", "three\nfour\n", "stored"), ("c.log", "new\n", "stored")]
    assert logs.cycle() == [("a.log", "fi", "stored")]  # it has not grown: the rest
    assert logs.cycle() == []
    logs.add("a.log", "ve\nsix\n")
    assert logs.cycle() == [("a.log", "ve\nsix\n", "stored")]
    (logs.folder / "a.log").write_text("again\n")  # cut, and written anew
    assert logs.cycle() == [("a.log", "again\n", "stored")]
    places = {r.path: (r.size, r.end) for r in logs.follower().places().collect()}
    assert places == {"/log/a.log": (6, 6), "/log/b.log": (2, 2), "/log/c.log": (4, 4), "/log/none.log": (0, 0)}


def test_an_interrupted_cycle_is_finished(logs, monkeypatch):
    logs.add("a.log", "one\n")
    with monkeypatch.context() as m:
        m.setattr(SampleStore, "add_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            logs.cycle()
    logs.add("a.log", "two\n")
    assert logs.cycle() == [("a.log", "one\n", "stored")]
    assert logs.cycle() == [("a.log", "two\n", "stored")]
    assert logs.cycle() == []


def test_a_failure_is_tried_again(logs):
    logs.add("a.log", "one\n")
    (logs.folder / "b.log").mkdir()  # a directory is no file
    assert logs.cycle() == [("a.log", "one\n", "stored")]
    follower = logs.follower()
    number, state = follower.plans.latest()
    logs.add("a.log", "two\nthree\n")
    follower._plan(number, state, logs.targets)
    (logs.folder / "a.log").rename(logs.folder / "a.old")  # gone between plan and read
    assert logs.cycle() == [("a.log", "", "error")]
    assert logs.cycle() == []  # not listed
    (logs.folder / "a.old").rename(logs.folder / "a.log")
    assert logs.cycle() == [("a.log", "two\nthree\n", "stored")]


def test_places_of_lost_files_are_forgotten(logs):
    logs.add("a.log", "one\n")
    logs.cycle()
    (logs.folder / "a.log").rename(logs.folder / "a.old")
    for _ in range(2):
        assert logs.cycle(forget_after=2) == [] and logs.follower().places().count() == 1
    logs.cycle(forget_after=2)
    assert logs.follower().places().count() == 0


def test_compressed_files_come_whole(logs):
    (logs.folder / "a.log.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    options = {"patterns": ("*.gz",)}
    assert logs.cycle(**options) == []
    assert logs.cycle(**options) == [("a.log.gz", "one\ntwo\n", "stored")]
    assert logs.cycle(**options) == []


def test_parts_are_read_in_ranges(logs, monkeypatch):
    logs.add("a.log", "first\n")
    logs.cycle()
    added = [f"line {i} é" for i in range(300)]
    logs.add("a.log", "\n".join(added) + "\n")
    from logprism.sources import files
    monkeypatch.setattr("logprism.streaming.follow.read_lines", lambda rows, root: files.read_lines(rows, root, 100))
    (row,) = logs.follower(n=1000).cycle(logs.targets).collect()
    assert row.sample_content == "\n".join(added) + "\n" and row.line_count == 300


def test_the_clock_runs_cycles(logs, tmp_path):
    logs.add("a.log", "one\n")
    follower = logs.follower()
    query = follow(follower, lambda: logs.targets, str(tmp_path / "clock"), interval="1 second")
    until = time.monotonic() + 120
    try:
        while follower.store.last_batch("s") < 1 and time.monotonic() < until and query.isActive:
            time.sleep(1)
    finally:
        query.stop()
    logs.add("a.log", "two\n")
    query = follow(logs.follower(), lambda: logs.targets, str(tmp_path / "clock"), interval="1 second")
    try:
        while follower.store.read("samples").count() < 2 and time.monotonic() < until and query.isActive:
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(r.sample_content for r in follower.store.read("samples").collect()) == ["one\n", "two\n"]
