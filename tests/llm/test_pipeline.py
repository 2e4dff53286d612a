import check
import corpus_pipeline
import pytest
from __spark_entry__ import oracle_sql, queries
from logprism.llm import ngram_join
from logprism.llm.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert check.compare(QUERIES[name](spark, sf_dir), check.open_tables(sf_dir), name) == ""


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())
    assert [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")] == list(QUERIES)


def test_every_stage_acts_on_what_came_before(spark, docs_frame):
    base = "Anou thoning anerin is is rerest ountes erorer tion onreor oushly erwh and ou andorntan reed the thou thoner that was in the end"
    passage = "\n".join(f"{base} line {i}" for i in range(3))
    rows = [(i, f"{base} {i} {base[::-1]} {i * 7}\nown line {i}\n{'again ' + str(i)}", "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "en", "s0"), (101, "123 456", "en", "s0")]  # no language
    rows += [(110, f"{passage}\nfirst", "en", "s1"), (111, f"other start\n{passage}\nother end of it", "en", "s1")]  # a passage twice
    rows += [(120, f"{base} and more of it {base[5:]} so that it is long", "en", "s2"), (121, f"{base} and more of it {base[5:]} so that it is longer", "en", "s2")]
    docs, seen = docs_frame(rows), []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, "")
        docs = spark.createDataFrame(done.collect(), done.schema)
        seen.append(docs)
    ids = [{r["doc_id"] for r in s.collect()} for s in seen]
    assert ids[0] == {r[0] for r in rows} - {100, 101}
    assert ids[1] == ids[0]
    assert {r["doc_id"]: r["text"] for r in seen[1].collect()}[111] == "other start\nother end of it"
    near = {r["doc_id"] for r in ngram_join.ngram_report(seen[1]).where("doc_id <> class_id").collect()}
    assert 121 in near and ids[2] == ids[1] - near
    assert ids[3] <= ids[2]
    copies = [r["doc_id"] for r in seen[3].collect()]
    assert sum(r["piece"] == 0 for r in seen[4].collect()) == len(copies)
    for s in seen[:4]:
        assert s.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_documents(spark, docs_frame):
    docs = docs_frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_pipeline_against_brute_force(spark, sf_dir):
    import test_line_dedup
    import test_ngram_join
    import test_packing

    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(done.collect(), done.schema)
        results.append([r.asDict() for r in docs.collect()])
    named, lines, distinct, mixed, packed = results
    assert len(named) > 190
    want = {d: t for d, t, n, gone in test_line_dedup.brute([(r["doc_id"], r["text"]) for r in named]) if gone == 0 or gone < n}
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    want = {d for d, c, _ in test_ngram_join.brute([(r["doc_id"], r["text"]) for r in lines]) if d == c}
    assert {r["doc_id"] for r in distinct} == want
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= want and max(times.values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in mixed}
    once, seen = [], {}
    for r in packed:
        seen[r["doc_id"], r["piece"]] = seen.get((r["doc_id"], r["piece"]), 0) + 1
        if seen[r["doc_id"], r["piece"]] == 1:
            once.append(r)
    assert all(n == times[d] for (d, _), n in seen.items())
    whole = test_packing.Tokenizer.from_file(test_packing.public_tokenizers.path("byte_bpe_50k.json"))
    for d, text in texts.items():
        assert sum(r["length"] for r in once if r["doc_id"] == d) == len(whole.encode(text, add_special_tokens=False).ids) + 1
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for filled in places.values():
        filled.sort()
        assert [o for o, _ in filled] == [sum(n for _, n in filled[:i]) for i in range(len(filled))]
        assert sum(n for _, n in filled) <= 2048
