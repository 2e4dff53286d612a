import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logprism.llm import token_files, tokenizing
from logprism.llm.elias_fano import EliasFano
from logprism.llm.storage import scratch
from logprism.llm.tokenizing import ChunkTokenizer

TEXTS = ["", "Hello  world\n\n it's", "a\x1cb \x1d!\x1e c\x85d\xa0e", "  lead", "trail  \t\n", "x" * 5000, "ΑΣ ΣΑΣ. İstanbul é ́z", "don't WE'LL 1234 $$$ ###", "日本語 テスト", "<|endoftext|> a<|endoftext|>b", "﻿​ x"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(alphabet="abI. ,' 's\n\t\x1c\x85\xa0é!1Σ́", max_size=40)), max_size=5))
def test_chunks_give_the_ids_of_the_tokenizer(texts):
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        tokenizer = ChunkTokenizer(path, spaces)
        for _ in range(2):  # from the cache, too
            ids, bounds = tokenizer.encode(pa.array(texts, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 10**6), st.integers(0, 2**62)), max_size=700).map(sorted))
def test_elias_fano_gives_the_numbers_back(values):
    code, used = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes() + b"more")
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    for start, end in ((0, 0), (len(values) // 3, len(values)), (len(values) // 2, len(values) // 2 + 1)):
        assert code.part(start, min(end, len(values))).tolist() == values[start:end]
    assert used == len(code.to_bytes())


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(EliasFano.encode(bounds).to_bytes()) < 10_000 * 12.5 / 8 + 100


def brute(rows):
    whole, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def report(docs):
    return sorted((tuple(r) for r in token_files.token_report(docs).collect()), key=lambda r: r[1])


def test_against_the_tokenizer(spark, docs_frame):
    rows = [(i * 37 - 500, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(200)] + [(None, "no id"), (10**15, None), (-(2**62), "far")]
    assert report(docs_frame([(*r, None, None) for r in rows])) == brute(rows)
    assert report(docs_frame([])) == []
    same = report(docs_frame([(1, "b c", None, None), (1, "a", None, None), (1, "a", None, None)]))
    assert [r[2] for r in same] == [2, 2, 3] and [r[1] for r in same] == [0, 2, 4]


def test_documents_are_found_by_select(spark, docs_frame):
    rows = [(i, f"word {i} " * (i % 7), None, None) for i in range(300)]
    manifest = token_files.write_tokens(docs_frame(rows), scratch(spark, "tokens-test"), shard_bytes=1500).orderBy("shard", "no").collect()
    assert len(manifest) > 3
    whole, seen = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for entry in manifest:
        shard = token_files.Shard(entry["file"])
        assert len(shard) == entry["n_docs"]
        for i, doc_id in enumerate(shard.doc_ids()):
            assert shard.document(i).tolist() == [*whole.encode(rows[doc_id][1], add_special_tokens=False).ids, 2]
            seen.append(doc_id)
    assert seen == list(range(300))


def test_hot_ids_fill_many_shards(spark, docs_frame, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 400)
    monkeypatch.setattr(token_files, "READ_DOCS", 7)
    monkeypatch.setattr(token_files, "SUM_SHARDS", 3)
    rows = [(None, f"none {i}") for i in range(200)] + [(5, f"five {i}") for i in range(200)] + [(i, f"word {i}") for i in range(6, 60)] + [(9, "same same")] * 300
    docs = docs_frame([(*r, None, None) for r in rows])
    manifest = token_files.write_tokens(docs, scratch(spark, "tokens-test"), shard_bytes=500)
    files = manifest.orderBy("shard", "no").collect()
    of = {e["file"]: set(token_files.Shard(e["file"]).doc_ids()) for e in files}
    assert sum(ids == {None} for ids in of.values()) > 3 and sum(ids == {5} for ids in of.values()) > 3 and any(e["no"] > 2 for e in files)
    assert [i for e in files for i in token_files.Shard(e["file"]).doc_ids()] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    found = sorted((tuple(r) for r in token_files.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()
    assert sorted(((r[0] or -1, *r[2:]) for r in found)) == sorted((r[0] or -1, *r[2:]) for r in brute(rows))


def test_documents_are_neither_joined_nor_broadcast(spark, docs_frame, monkeypatch):
    seen = []
    rows = docs_frame([(i, f"word {i} " * 20, None, None) for i in range(500)])
    manifest = token_files.write_tokens(rows, scratch(spark, "tokens-test"), shard_bytes=300)
    plan = token_files.read_tokens(manifest)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Join" not in above and "Exchange" not in above and manifest.count() > 60
    from logprism.llm import ranges
    monkeypatch.setattr(ranges.F, "broadcast", lambda df: seen.append(df.count()) or df)
    assert ranges.range_cuts(spark.range(1000), "id", ranges.F.lit(1), 100)
    assert not seen  # even keys need one round, without a join


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"something else entirely")
    with pytest.raises(ValueError, match="no token ids"):
        token_files.Shard(str(tmp_path / "x"))


def test_a_cache_takes_little_memory():
    path, letters = public_tokenizers.path("byte_bpe_50k.json"), "abcdefghij"
    tokenizer = ChunkTokenizer(path, True)
    words = ["".join(letters[int(d)] for d in str(n)) for n in range(100_000, 220_000)]
    tokenizer.encode(pa.array(["warm up"]))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for i in range(0, len(words), 20_000):
        tokenizer.encode(pa.array([" ".join(words[i:i + 20_000])]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 100 * len(words)


def test_words_that_left_the_cache_come_back(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHED", 40)
    for name, byte_level in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        whole, tokenizer = Tokenizer.from_file(path), ChunkTokenizer(path, byte_level)
        for n in (*range(30), *range(30)):
            texts = [f"Word {n}, same. Übung{n} {'x' * n * 5}, é{'abc' * (n % 4)}.", "", " ".join(f"{c * n}." for c in "pqr")]
            ids, bounds = tokenizer.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(tokenizer.chunks) <= 40


def test_texts_with_every_control_sign():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["".join(map(chr, range(32))) + " a  b", "some more\n words", None, "\x01 x\x02\ny"]
    for part in (texts, texts[1:]):
        lot = pa.array([t or "" for t in part])
        ids, bounds = ChunkTokenizer(path, True).encode(lot)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in lot.to_pylist()]
