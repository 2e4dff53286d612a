import gzip
import hashlib
from pathlib import Path

from logprism.llm import warc
from logprism.llm.storage import scratch

SCHEMA = "page_id long, url string, html string, digest string, kind string"
LONG = "x" * 1000


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)


def report(spark, rows):
    return sorted((tuple(r) for r in warc.warc_report(pages(spark, rows)).collect()), key=str)


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


def test_copies_are_revisits_of_the_largest_id(spark):
    rows = [(1, "http://a", LONG), (5, "http://b", LONG), (3, "http://c", LONG), (2, "u", "short"), (4, "u", "short"), (6, "é", "ü" * 500), (7, None, None)]
    got = {r[0]: r[1:] for r in report(spark, rows)}
    assert got[5] == (1000, sha(LONG), "response", None)
    assert got[1] == got[3] == (1000, sha(LONG), "revisit", 5)
    assert got[2] == got[4] == (5, sha("short"), "response", None)
    assert got[6] == (1000, sha("ü" * 500), "response", None)
    assert got[7] == (0, sha(""), "response", None)


def test_odd_rows(spark):
    rows = [(None, "http://a b\r\nX: y", LONG), (9, "", LONG), (9, "", LONG), (8, "", ""), (-4, "v", "a\r\n\r\nb")]
    got = report(spark, rows)
    assert (None, 1000, sha(LONG), "revisit", 9) in got
    assert sum(r == (9, 1000, sha(LONG), "response", None) for r in got) == 2
    assert (-4, 6, sha("a\r\n\r\nb"), "response", None) in got
    assert len(got) == 5
    assert report(spark, []) == []


def test_archives_are_the_same_on_every_run_and_roll(spark):
    rows = pages(spark, [(i, f"http://p/{i}", f"page {i % 40} " * 300) for i in range(200)])
    found = []
    for parts in (3, 7):
        folder = scratch(spark, "warc-test")
        manifest = warc.write_warc(rows.repartition(parts), folder, shard_bytes=100_000, roll_bytes=2_000)
        files = sorted(Path(folder).glob("*.warc.gz"))
        assert {f.name for f in files} == {Path(r["file"]).name for r in manifest.collect()}
        assert not list(Path(folder, "_temporary").iterdir())
        found.append({f.name: f.read_bytes() for f in files})
        text = gzip.decompress(files[0].read_bytes()).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo")
        assert sum(r["records"] for r in manifest.collect()) == 200
    assert found[0] == found[1]
    assert len(found[0]) > len({name[:12] for name in found[0]}) > 1
