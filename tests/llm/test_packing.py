import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logprism.llm import packing


def best_fit_decreasing(sizes, length):
    room, total = [], 0
    for size in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= size
        else:
            room.append(length - size)
            total += 1
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(sizes):
    used, placed = defaultdict(list), Counter()
    for size, first, last, start, offset in packing.plan_bins(Counter(sizes), 20):
        placed[size] += last - first
        for i in range(last - first):
            used[start + i].append((offset, size))
    assert placed == Counter(sizes)
    for filled in used.values():
        at = 0
        for offset, size in sorted(filled):
            assert offset == at
            at += size
        assert at <= 20
    assert sorted(20 - sum(s for _, s in f) for f in used.values()) == best_fit_decreasing(sizes, 20)


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(0)
    few = Counter(rng.randint(1, 2048) for _ in range(100_000))
    many = Counter({k: 1000 * n for k, n in few.items()})
    assert len(packing.plan_bins(many)) < 60_000


def test_tree_finds_the_tightest():
    tree = packing.OpenBins(16)
    assert tree.tightest(1) is None
    for c in (3, 9, 16):
        tree.change(c, 1)
    assert [tree.tightest(s) for s in (1, 3, 4, 9, 10, 16)] == [3, 3, 9, 9, 16, 16]
    tree.change(16, -1)
    assert tree.tightest(10) is None


def check(rows, found):
    whole, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for doc_id, text in rows:
        ids[doc_id] = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc_id, parts in pieces.items():
        at = 0
        for i, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["length"] == 2048 or i == 0
            assert r["ids_crc32"] == zlib.crc32(ids[doc_id][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc_id])
    for filled in bins.values():
        at = 0
        for offset, size in sorted(filled):
            assert offset == at
            at += size
        assert at <= 2048
    return len(bins)


def test_documents_are_packed_whole(docs_frame):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.randrange(10**4)) for _ in range(rng.choice([0, 5, 50, 300, 3000])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, " lead\n\n  x ")]
    found = packing.packed(docs_frame([(*r, None, None) for r in rows])).collect()
    bins = check(rows, found)
    assert bins == len(best_fit_decreasing([r["length"] for r in found], 2048))


def test_repeated_rows_and_empty(docs_frame):
    found = packing.packed(docs_frame([(1, "a", None, None)] * 5000)).collect()
    assert len(found) == 5000 and len({(r["sequence_id"], r["offset"]) for r in found}) == 5000
    assert len({r["sequence_id"] for r in found}) == -(-10_000 // 2048)
    assert packing.packed(docs_frame([])).collect() == []
