import random
import re

import numpy as np

from logprism.llm import ngram_join
from logprism.llm.clusters import spanning_links
from logprism.llm.components import components


def grams(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links = {k: [m for m in range(len(rows)) if m != k and sets[k] and sets[m]
                 and len(sets[k] & sets[m]) / len(sets[k] | sets[m]) >= 0.8] for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((rows[k][0], min((rows[m][0] for m in seen if rows[m][0] is not None), default=None), len(links[k])))
    return out


def run(docs):
    return sorted((tuple(r) for r in ngram_join.ngram_report(docs).collect()), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared = " ".join(word() for _ in range(30))
    rows, n = [], 0
    for _ in range(60):
        rows.append((n := n + 1, " ".join(word() for _ in range(rng.randint(1, 200))) + rng.choice(["", " " + shared])))
    for size, of in ((3, 5), (40, 9), (70, 12)):
        base = (rows[of][1] + " " + shared + " " + " ".join(word() for _ in range(60))).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
            rows.append((n := n + 1, " ".join(words)))
    rows += [(n + i, rows[70][1]) for i in range(1, 30)]
    return rows


def test_against_brute_force(docs_frame, monkeypatch):
    rows = corpus()
    docs = docs_frame([(*r, None, None) for r in rows])
    want = sorted(brute(rows), key=str)
    assert run(docs) == want
    for name, value in (("SMALL", 8), ("BLOCK", 16), ("SET_BLOCK", 10)):  # deep nodes, and groups in blocks
        monkeypatch.setattr(ngram_join, name, value)
    assert run(docs) == want


def test_one_of_each_group_stays(docs_frame):
    rows = corpus()
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs_frame([(*r, None, None) for r in rows]).selectExpr("*", "1 AS id", "2 AS row", "3 AS n")).collect()}
    assert kept == {d for d, c, _ in brute(rows) if d == c}
    near = ngram_join.near_documents(docs_frame([(*r, None, None) for r in rows]), counts=False)
    assert near.columns == ["doc_id", "h", "component"] and near.count() == len(rows)


def test_odd_rows(docs_frame):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one\ntwo "), (6, "One two"), (7, "x " * 30000), (8, "x " * 30000), (9, "é   z"), (10, "é   z")]
    docs = docs_frame([(*r, None, None) for r in rows])
    assert run(docs) == sorted(brute(rows), key=str)
    assert run(docs_frame([])) == []
    got = run(docs_frame([(None, "a b", None, None), (1, "a b", None, None), (1, "a b", None, None), (None, "c", None, None), (None, "c", None, None)]))
    assert got == sorted([(None, 1, 2), (1, 1, 2), (1, 1, 2), (None, None, 1), (None, None, 1)], key=str)


A, B = "p q r s t u v w x y", "b c d e f g h i j k l m"


def kept(docs):
    return sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()), key=str)


def test_ids_that_are_repeated(docs_frame):
    rows = [(1, A), (1, A), (2, A), (5, B), (5, A), (7, B + " n"), (8, "other"), (8, "words here")]
    docs = docs_frame([(*r, None, None) for r in rows])
    assert run(docs) == sorted(brute(rows), key=str)
    assert kept(docs) == sorted([(1, A), (5, B), (8, "other"), (8, "words here")], key=str)


def test_repeated_rows_and_null_ids(docs_frame):
    rows = [(None, A), (None, A), (None, None), (None, None), (None, ""), (3, "a b"), (None, "a b"), (None, B), (4, B), (4, B), (4, B), (4, B + " n"), (6, None), (6, None)]
    docs = docs_frame([(*r, None, str(i)) for i, r in enumerate(rows)])
    assert run(docs) == sorted(brute(rows), key=str)
    fours = [t for i, t in kept(docs) if i == 4]
    assert len(fours) == 1 and fours[0] in (B, B + " n")
    assert [r for r in kept(docs) if r[0] != 4] == sorted([(None, A), (None, None), (None, None), (None, ""), (3, "a b"), (6, None), (6, None)], key=str)
    assert kept(docs) == kept(docs.orderBy("source")) and docs.columns == ngram_join.one_of_each(docs).columns


def test_recall_in_a_dense_group(spark, docs_frame, monkeypatch):
    """Links of 0.8 or more that candidates connect, where all sets share large nodes for three levels."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=300)
    texts = []
    for _ in range(60):  # pairs that are alike, in a crowd that shares half of its grams
        twin = base[:150] + rng.choices(words, k=150)
        other = list(twin)
        for i in rng.sample(range(300), 5):
            other[i] = rng.choice(words)
        texts += [" ".join(twin), " ".join(other)]
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    seen = []
    inner = ngram_join.candidates

    def held(sets, again):
        out = inner(sets, lambda deep: seen.append(deep.count()) or again(deep))
        return out

    monkeypatch.setattr(ngram_join, "candidates", held)
    rows = list(enumerate(texts))
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    found = {r["doc_id"]: r["component"] for r in ngram_join.near_documents(docs_frame([(*r, None, None) for r in rows]), counts=False).collect()}
    assert len(links) > 30 and seen and seen[0] > 100
    assert sum(found[i] == found[j] for i, j in links) >= 0.99 * len(links)


def near_copies(rng, words, base, n, changed):
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(len(base)), changed):
            copy[i] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def rows_by_level(monkeypatch):
    """How many rows each level writes, as the join runs."""
    counts, inner = [], ngram_join.stage

    def counted(rows, name):
        out = inner(rows, name)
        if name == "path-nodes":
            counts.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    return counts


def test_connected_nodes_are_not_split(docs_frame, monkeypatch):
    """A group of near copies is connected within parts of its nodes, and its sets go no further."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows = list(enumerate(near_copies(rng, words, rng.choices(words, k=250), 120, 1)))
    monkeypatch.setattr(ngram_join, "SMALL", 16)
    counts = rows_by_level(monkeypatch)
    assert run(docs_frame([(*r, None, None) for r in rows])) == sorted(brute(rows), key=str)
    assert counts[0] > 1000 and sum(counts[1:]) < counts[0] / 4


def test_near_copies_in_a_crowd(docs_frame, monkeypatch):
    """Large nodes of near copies, of sets a little off them, and of a crowd that shares a passage."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=40)
    base = passage + rng.choices(words, k=160)
    texts = near_copies(rng, words, base, 70, 1) + near_copies(rng, words, base, 12, 5) + near_copies(rng, words, base, 12, 20)
    for _ in range(30):
        other = passage + rng.choices(words, k=100)
        texts += [" ".join(other), *near_copies(rng, words, other, 1, 2)]
    rows = list(enumerate(texts))
    want = sorted(brute(rows), key=str)
    cut, inner = [], ngram_join._rest

    def rest(own, nodes):
        out = inner(own, nodes)
        cut.append((out.where("top").count(), out.where("NOT top AND low > 0").count()))
        return out

    monkeypatch.setattr(ngram_join, "_rest", rest)
    for name, value in (("SMALL", 16), ("PART", 8), ("BLOCK", 32), ("SET_BLOCK", 30)):
        monkeypatch.setattr(ngram_join, name, value)
    assert run(docs_frame([(*r, None, None) for r in rows])) == want
    assert all(sum(x) > 0 for x in zip(*cut))


def test_pairs_left_in_a_node(spark):
    own = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 5, 8, 9])] + [(2, 10, 5), (2, 11, 5)], "node long, rep long, c long")
    assert sorted(tuple(r) for r in ngram_join._largest(own).collect()) == [(1, 5, 5, 7), (2, 2, 5, 0)]


def test_links_to_what_is_reached():
    asked = []

    def linked(i, others):
        asked.append((i, others.tolist()))
        return abs(others - i) == 1

    links = list(spanning_links(6, linked, [0, 1, 4]))
    assert sorted(j for _, j in links) == [2, 3, 5] and all(abs(i - j) == 1 for i, j in links)
    assert all(not {0, 1, 4} & set(others) for _, others in asked)
    assert list(spanning_links(3, linked, [0, 1, 2])) == [] and sorted(spanning_links(3, linked)) == [(0, 1), (1, 2)]


def test_runs_until_the_target():
    assert [ngram_join.runs_needed(k) for k in (1, 2, 3)] == [12, 19, 25]


def test_hashes_follow_the_words():
    a, b = ngram_join.gram_sets(["p q r s t u", "p\nq  r\ts t u "])
    assert (a == b).all() and a.size == 2
    rng = random.Random(0)
    texts = [" ".join(str(rng.randrange(500)) for _ in range(400)) for _ in range(20)]
    for text, tokens in zip(texts, ngram_join.gram_sets(texts)):
        assert tokens.size == len(grams(text))


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similar_counts_exactly():
    sets = [np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64), np.arange(3, dtype=np.uint64)]
    assert ngram_join.similar(sets).tolist() == [[True, True, False], [True, True, False], [False, False, True]]
