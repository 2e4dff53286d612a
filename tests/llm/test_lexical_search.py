import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logprism.llm import lexical_search as ls
from logprism.llm.terms import terms

ITEMS = "item_id long, text string, rank int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, top):
    counted = [(d, Counter(cut(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = set()
    for item, words in asked.items():
        found = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in words & c.keys():
                df = sum(t in x for _, x in counted)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out |= {(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)}
    return out


def run(spark, docs_frame, docs, items, top):
    frame = docs_frame([(*d, None, None) for d in docs])
    return {tuple(r) for r in ls.lexical_search(frame, spark.createDataFrame([(*i, 1, "s") for i in items], ITEMS), top).collect()}


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(300)]
    docs += [(400 - i, docs[i][1]) for i in range(40)] + [(500 + i, docs[7][1]) for i in range(30)]  # ties
    return docs, [(i, text(rng.randint(1, 15))) for i in range(25)] + [(90, " ".join(words * 3))]


def test_against_brute_force(spark, docs_frame, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items, 7)
    assert run(spark, docs_frame, docs, items, 7) == want
    for name, value in (("BLOCK_TERMS", 60), ("CELLS", 300), ("FIRST_LOOK", 1)):  # parts of items, slices of documents
        monkeypatch.setattr(ls, name, value)
    assert run(spark, docs_frame, docs, items, 7) == want


def test_odd_rows(spark, docs_frame):
    docs = [(1, None), (2, ""), (3, " \n..!"), (4, "One-one TWO É\x7fé"), (5, "one"), (5, "one two"), (5, "one two"), (None, "two two"), (None, "ÉÉ one"),
            (6, "x " * 700_000 + "one"), (7, "É"), (8, "y" * 3_000_000)]
    items = [(1, "ONE"), (1, "two two"), (None, "é É"), (2, None), (3, ""), (4, "absent"), (5, "x"), (6, "y" * 3_000_000), (7, "!")]
    assert run(spark, docs_frame, docs, items, 50) == brute(docs, items, 50)
    assert run(spark, docs_frame, [], items, 5) == set()
    assert run(spark, docs_frame, docs, [], 5) == set()


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr("logprism.llm.terms.PART", 7)
    text = "Aé_bC 12\n\x00x" * 9 + "😀 " + "long" * 20
    assert [t.decode() for part in terms(text) for t in part] == cut(text)


def test_masks_of_many_terms():
    rng = np.random.default_rng(2)
    held = rng.random((150, 40)) < 0.5
    held[:, 20:] = held[:, :20]
    kinds, of = ls.masks(held)
    assert len(kinds) == 20 and (kinds[of].T == held).all()


@pytest.mark.parametrize("top", [1, 5])
def test_low_masks_are_not_scored(top):
    tf = np.zeros((2, 10_000), np.int32)
    tf[0] = 1
    tf[1, :50] = 1  # a rare term, worth more than the common one can give
    best = ls.Best(top, np.zeros(0, np.int64), np.zeros(0, np.int64))
    m, weights = np.full(10_000, 100), np.array([10, 5000])
    scored = ls.search_masks(tf, m, np.arange(10_000), weights, weights * ls.impact(np.array([1, 1]), np.array([100, 100])), best)
    assert best.ids.tolist() == list(range(top)) and scored == 50
