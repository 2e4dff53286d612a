"""Best-fit decreasing packing of whole documents into sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logprism.llm.prefix import prefix_sums
from logprism.llm.storage import release_memory, stage
from logprism.llm.tokenizing import in_lots, worker_tokenizer

LENGTH = 2048
END = (0).to_bytes(4, "little")
ROW_BLOCKS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 0. Documents of more than ``length`` ids are cut
    from the end, so that only the first piece may be shorter. A null text is empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer, True)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, lot in in_lots(batch.column(1)):
                rows = []
                ids, bounds = encoder.encode(lot)
                for doc_id, first, last in zip(doc_ids[at:at + len(lot)], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = last - first + 1
                    start, no, size = 0, 0, (n - 1) % length + 1
                    while start < n:
                        end = start + size
                        crc = zlib.crc32(ids[first + start:first + min(end, n - 1)])
                        rows.append((doc_id, no, start, size, crc if end < n else zlib.crc32(END, crc)))
                        start, no, size = end, no + 1, length
                yield pa.RecordBatch.from_arrays([
                    pa.array(column, kind) for column, kind in
                    zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
                ], ["doc_id", "piece", "start", "length", "ids_crc32"])
            release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class OpenBins:
    """Segment tree over remaining capacities: which capacities have open bins.

    ``tightest`` finds the smallest capacity of at least a size that has a bin, in time
    logarithmic in the capacity.
    """

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, size: int) -> int | None:
        node = self.leaves + size
        while not self.open[node]:
            while node & 1:  # climb until there is a subtree to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_bins(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[size]`` pieces of each size.

    Pieces of equal size, and bins of equal remaining capacity, are alike, so they are
    placed by the run: (size, first rank, last rank + 1, first bin, offset). Work and
    memory depend on ``length``, not on the number of pieces.
    """
    tree, bins, plan, made = OpenBins(length), defaultdict(deque), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            capacity = tree.tightest(size)
            if capacity is None:  # nothing fits: open as many bins as the rest of this size fills
                capacity, fresh = length, -(-left // (length // size))
                bins[length].append((made, made + fresh))
                tree.change(length, fresh)
                made += fresh
            first, last = bins[capacity].popleft()
            each = min(capacity // size, left)  # the tightest bin stays the tightest while another piece fits
            taken = min(left // each, last - first)
            if first + taken < last:
                bins[capacity].appendleft((first + taken, last))
            for i in range(each):
                plan.append((size, rank, rank + taken, first, length - capacity + i * size))
                rank += taken
            rest = capacity - each * size
            tree.change(capacity, -taken)
            if rest:
                bins[rest].append((first, first + taken))
                tree.change(rest, taken)
            left -= each * taken
    return plan


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces: best-fit decreasing over all of them.

    The number of pieces per size (``length`` numbers at most) decides which runs of
    pieces go to which sequences. Each piece's place in its run comes from its rank
    among the pieces of its size. Ties in size go by doc_id and piece. The plan is
    broadcast: its runs depend on ``length`` and come to some tens of thousands.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = cut.sparkSession.createDataFrame(
        plan_bins(counts, length) or [(0, 0, 0, 0, 0)], "_size long, _from long, _to long, _bin long, offset long")
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ROW_BLOCKS))
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    ranked = prefix_sums(cut.withColumn("_block", block).withColumn("_one", F.lit(1).cast("long")), "length", "_block", order, "_one", "_rank")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_bin") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def packed(docs: DataFrame) -> DataFrame:
    """All documents tokenized, cut and packed: see ``pieces`` and ``pack``."""
    return pack(stage(pieces(docs), "pieces"))
