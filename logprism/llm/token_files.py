"""Token ids in binary shards, with Elias-Fano coded document boundaries."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from logprism.llm.elias_fano import EliasFano
from logprism.llm.prefix import prefix_sums
from logprism.llm.ranges import weighed_ranges
from logprism.llm.storage import file_system, release_memory, scratch
from logprism.llm.tokenizing import in_lots, worker_tokenizer

MAGIC = b"TOKIDS01"
END_ID = 2
SHARD_BYTES = 16 << 20  # of text
FILE_BYTES = 64 << 20  # of ids, after which a shard goes on in another file
READ_DOCS = 4096  # documents read at a time
SUM_SHARDS = 4096  # whose tokens are added up in a task
ENTRY = "shard int, no int, file string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shard(uri: str, doc_ids: list[int | None], sizes: list[int], parts: Iterable[bytes], wide: bool) -> None:
    """One file: magic, header length, JSON header, boundaries, ids of documents, token ids.

    Document ids are stored as differences to the least; nulls come first and are counted.
    """
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if known.size else 0
    bounds = EliasFano.encode(np.cumsum([0, *sizes])).to_bytes()
    names = EliasFano.encode(known.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
    header = json.dumps({"nulls": nulls, "least": least, "bytes": 4 if wide else 2, "bounds": len(bounds), "names": len(names)}).encode()
    fs, path = file_system(uri)
    with fs.open_output_stream(path) as out:
        out.write(MAGIC + len(header).to_bytes(4, "little") + header + bounds + names)
        for part in parts:
            out.write(part)


class Shard:
    """A shard opened for reading; ids are read by document, not as a whole."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read(len(MAGIC) + 4)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} holds no token ids")
        size = int.from_bytes(head[-4:], "little")
        self.header = json.loads(self.file.read(size))
        self.bounds, _ = EliasFano.from_bytes(self.file.read(self.header["bounds"]))
        self.names, _ = EliasFano.from_bytes(self.file.read(self.header["names"]))
        self.base = len(head) + size + self.header["bounds"] + self.header["names"]
        self.kind = np.dtype("<u4" if self.header["bytes"] == 4 else "<u2")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_ids(self, start: int = 0, end: int | None = None) -> list[int | None]:
        end, nulls = len(self) if end is None else end, self.header["nulls"]
        known = self.names.part(max(0, start - nulls), max(0, end - nulls)).astype(np.int64) + self.header["least"]
        return [None] * (min(end, nulls) - min(start, nulls)) + known.tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.base + start * self.kind.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.kind.itemsize), self.kind)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by two selects."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards in ascending doc_id order below ``folder``; returns the manifest's entries.

    Texts are tokenized where they are read; only compressed ids are shuffled. Ranges of
    doc_id become shards, the same on every run. A null text is empty, so its document
    holds the end id only. Documents with a null id come first; equal ids stay together.
    Where these, or the documents of one id, fill several shards, they are dealt to them by
    a hash of the text; in a shard they are in order of their ids. A shard goes on in
    another file after ``FILE_BYTES``, so that no more is held in memory, also where one
    row is repeated without end. A file is written under a name of its attempt, and the
    manifest, committed by Spark, names the files of the attempts that count.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts, weights, nulls = weighed_ranges(keyed, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 4, shard_bytes)
    lots = np.maximum(1, -(-np.array([nulls, *weights], np.int64) // (2 * shard_bytes)))  # shards of null and of each range
    first = np.cumsum([0, *lots])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, bounds = worker_tokenizer(tokenizer, False), zstandard.ZstdCompressor(1), np.array(cuts[1:], np.int64)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, lot in in_lots(batch.column(1)):
                names = doc_ids[at:at + len(lot)]
                ids, ends = encoder.encode(lot)
                # two bytes an id where all of a lot fit
                kind = b"4" if ids.size and int(ids.max()) >> 16 or end_id >> 16 else b"2"
                ids, end = ids.astype(f"<u{kind.decode()}"), np.array([end_id], f"<u{kind.decode()}").tobytes()
                coded = [packer.compress(kind + ids[a:b].tobytes() + end) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                known = batch.column(0).slice(at, len(lot))
                of = np.where(known.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(bounds, known.fill_null(0).to_numpy(zero_copy_only=False), side="right"))
                shards = first[of]
                for i in np.flatnonzero(lots[of] > 1):
                    shards[i] += xxhash.xxh64_intdigest(lot[int(i)].as_py() or "") % int(lots[of[i]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(shards, pa.int32()), pa.array(names, pa.int64()), pa.array(np.diff(ends) + 1, pa.int64()),
                    pa.array(coded, pa.binary())], ["shard", "doc_id", "n", "ids"])
        release_memory()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, shard, no, names, sizes, parts, held = zstandard.ZstdDecompressor(), None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal names, sizes, parts, held
            wide = any(p[:1] == b"4" for p in parts)
            ready = (p[1:] if not wide or p[:1] == b"4" else np.frombuffer(p[1:], "<u2").astype("<u4").tobytes() for p in parts)
            file = f"{folder}/shard-{shard:06d}-{no:04d}-{uuid.uuid4().hex}.ids"
            write_shard(file, names, sizes, ready, wide)
            entry = {"shard": shard, "no": no, "file": file, "n_docs": len(names), "n_tokens": sum(sizes)}
            names, sizes, parts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([entry], pa.schema(
                [("shard", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for s, name, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is not None and (s != shard or held >= FILE_BYTES):
                    yield close()
                    no = no + 1 if s == shard else 0
                shard = s
                names.append(name)
                sizes.append(n)
                parts.append(unpacker.decompress(ids))
                held += len(parts[-1])
        if shard is not None:
            yield close()

    spark = docs.sparkSession
    coded = keyed.mapInArrow(encode, "shard int, doc_id long, n long, ids binary")
    sorted_rows = coded.repartitionById(int(first[-1]), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "ids")
    make_folder(folder)
    sorted_rows.mapInArrow(write, ENTRY).write.parquet(f"{folder}/manifest")
    return spark.read.schema(ENTRY).parquet(f"{folder}/manifest")


def make_folder(folder: str) -> None:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    The ids before a file are added up from the manifest, by blocks of shards, and go to the
    task that reads it; documents are not joined with anything.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(file)
                for i in range(0, len(shard), READ_DOCS):
                    end = min(len(shard), i + READ_DOCS)
                    part = shard.bounds.part(i, end + 1).astype(np.int64)
                    ids = shard.ids(int(part[0]), int(part[-1])).astype("<u4")
                    crcs = [zlib.crc32(ids[a - part[0]:b - part[0]].tobytes()) for a, b in zip(part[:-1], part[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids(i, end), pa.int64()), pa.array(part[:-1] + before), pa.array(np.diff(part), pa.int64()),
                        pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = manifest.withColumn("every", F.lit(0)).withColumn("block", F.floor(F.col("shard") / F.lit(SUM_SHARDS)))
    placed = prefix_sums(blocks, "every", "block", [F.col("shard"), F.col("no")], "n_tokens", "before")
    return placed.select("file", "before").repartition(max(1, manifest.count())).mapInArrow(read, DOCS)


def token_report(docs: DataFrame) -> DataFrame:
    """Writes all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, scratch(docs.sparkSession, "token-ids")))
