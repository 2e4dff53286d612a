"""WARC archives of pages: a deterministic sharded writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, functions as F

from logprism.llm.ranges import range_cuts, range_number
from logprism.llm.storage import file_system, scratch, stage

SHARD_BYTES = 16 << 20  # of payload
ROLL_BYTES = 64 << 20  # of compressed records, after which a file ends
LEAST = 1000  # bytes of a payload that others may refer to
DATE = "1970-01-01T00:00:00Z"
ENTRY = "shard int, no int, temporary string, file string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, place long"
CHUNK = 1 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def clean_uri(url: str | None, page_id: int | None) -> str:
    """A header value: white space and control signs are percent-encoded; a null url names the page."""
    if not url:
        return record_id(page_id)[1:-1]
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member; equal records give equal bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, revisit: bool) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
               ("WARC-Date", DATE), ("WARC-Target-URI", clean_uri(url, page_id)),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(refers_to))]
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    return member([*headers, ("WARC-Block-Digest", f"sha1:{digest}")], block)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload another page holds already.

    Of equal payloads of ``least`` bytes or more, the largest page_id is the one to refer
    to; rows that share that id are all responses. Pages without an id only refer.
    """
    long = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    best = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return long.join(best, "digest").where("refers_to is not null and not (page_id <=> refers_to)").distinct()


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row of page_id, url, html below ``folder``; returns the manifest.

    Ranges of page_id become shards, the same on every run, and a shard's rows are
    sorted; so archives of equal pages are equal byte by byte. A file ends once its
    compressed records reach ``roll_bytes``. Tasks write under names of their attempt.
    Spark commits the list of the attempts that count; then these files get their final
    names, and the manifest is written last. A null html is an empty payload; rows
    without an id come first; repeated rows are records of their own.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    cuts = range_cuts(rows, "page_id", F.coalesce(F.octet_length("html"), F.lit(0)) + 500, shard_bytes)
    # Decisions travel to the shards as rows of their own, ahead of their page, so texts move once.
    told = revisits(rows).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(0).alias("kind"))
    both = told.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)))
    placed = both.withColumn("shard", range_number(F.col("page_id"), cuts)).repartitionById(max(1, len(cuts)), "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_first(), F.col("digest").asc_nulls_first(), "kind", F.col("url").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, out, files, shard, told = uuid.uuid4().hex, None, [], None, None

        def start() -> None:
            nonlocal out
            no = sum(f["shard"] == shard for f in files)
            name = f"shard-{shard:06d}-{no:04d}.warc.gz"
            files.append({"shard": shard, "no": no, "temporary": f"{folder}/_temporary/{attempt}-{name}", "file": f"{folder}/{name}",
                          "records": 0, "bytes": 0, "sha1": hashlib.sha1()})
            fs, path = file_system(files[-1]["temporary"])
            out = fs.open_output_stream(path, compression=None)  # records are compressed one by one
            put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

        def put(data: bytes) -> None:
            out.write(data)
            files[-1]["sha1"].update(data)
            files[-1]["bytes"] += len(data)

        for batch in batches:
            for page_id, url, html, digest, refers_to, kind, place in zip(*(batch.column(c) for c in (
                    "page_id", "url", "html", "digest", "refers_to", "kind", "shard")), strict=True):
                key = (page_id.as_py(), digest.as_py())
                if not kind.as_py():
                    told = (*key, refers_to.as_py())
                    continue
                if place.as_py() != shard or files[-1]["bytes"] >= roll_bytes:
                    shard = place.as_py()
                    if out:
                        out.close()
                    start()
                revisit = told is not None and told[:2] == key
                put(page_record(key[0], url.as_py(), html.as_py(), told[2] if revisit else None, revisit))
                files[-1]["records"] += 1
        if out:
            out.close()
        done = [f | {"sha1": f["sha1"].hexdigest()} for f in files]
        yield pa.RecordBatch.from_pylist(done, pa.schema([
            ("shard", pa.int32()), ("no", pa.int32()), ("temporary", pa.string()), ("file", pa.string()),
            ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    fs, path = file_system(f"{folder}/_temporary")
    fs.create_dir(path, recursive=True)
    written = stage(placed.mapInArrow(write, ENTRY), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for temporary, file in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist(), strict=True):
                fs, old = file_system(temporary)
                new = file_system(file)[1]
                if fs.get_file_info(old).type != FileType.NotFound:  # else an earlier attempt has renamed it
                    fs.move(old, new)
            yield batch

    written.mapInArrow(commit, ENTRY).drop("temporary").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """The records of an archive, one in memory at a time, with their places."""
    unpacker, parts, data, place = zlib.decompressobj(wbits=31), [], b"", 0
    used = 0
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
        parts.append(unpacker.decompress(data))
        left = unpacker.unused_data if unpacker.eof else b""
        used += len(data) - len(left)
        data = left
        if unpacker.eof:
            yield place, b"".join(parts)
            unpacker, parts, place = zlib.decompressobj(wbits=31), [], used


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[:int(headers["Content-Length"])]


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per page record of the files in the manifest; digests of responses are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("place", pa.int64())])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = file_system(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for place, record in members(stream):
                        headers, block = parse(record)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, to = headers["WARC-Type"], headers.get("WARC-Refers-To")
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{file} at {place}: the payload does not fit its digest")
                        rows.append({"page_id": page_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "payload_bytes": size,
                                     "payload_digest": digest, "record_type": kind, "refers_to": to and page_of(to), "file": file.rpartition("/")[2], "place": place})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back."""
    read = read_warc(write_warc(pages, scratch(pages.sparkSession, "warc")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
 CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> best THEN best END AS refers_to FROM d"""
