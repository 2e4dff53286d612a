import math
import random
import zlib

import numpy as np
import pytest

from logprism.llm import language_id as lid

WORDS = {"xx": "the of and to in that was".split(), "yy": "der die und das nicht ein zu".split(), "zz": "что это как так".split()}


def texts(lang, n, seed, low=5, high=60):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))) for _ in range(n)]


def rows(n=120):
    return [(i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for k, lang in enumerate(WORDS) for t in texts(lang, n, k))]


def test_held_out_accuracy(docs_frame):
    found = {r["doc_id"]: r for r in lid.language_report(docs_frame(rows())).collect()}
    for doc_id, _, lang, _ in rows():
        r = found[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [d for d in rows() if found[d[0]]["held_out"]]
    assert np.mean([found[d[0]]["lang_pred"] == d[2] for d in held]) > 0.98
    assert not any(r["rejected"] for r in found.values())


def test_labels_of_held_out_rows_have_no_effect(docs_frame):
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, None) for i, t, lang, _ in rows()]
    a = {r["doc_id"]: tuple(r) for r in lid.language_report(docs_frame(rows())).collect()}
    b = {r["doc_id"]: tuple(r) for r in lid.language_report(docs_frame(changed)).collect()}
    assert a == b


def test_noise_is_rejected_and_clean_texts_stay(docs_frame):
    rng = random.Random(9)
    noise = [(1000 + i, " ".join("".join(rng.choices("qxjkvwzpbgfm", k=rng.randint(3, 9))) for _ in range(60)), None, None) for i in range(10)]
    kept = {r["doc_id"] for r in lid.accepted(docs_frame(rows() + noise)).collect()}
    assert kept == {r[0] for r in rows()}


def test_mislabelled_texts_do_not_lift_the_limit():
    clean = {lang: texts(lang, 400, k) for k, lang in enumerate(WORDS)}
    rng = random.Random(4)
    other = [" ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(5)) for _ in range(60)) for _ in range(8)]
    noisy = {**clean, "xx": [other[i // 50] if i % 50 == 0 else t for i, t in enumerate(clean["xx"])]}  # 0 and 200 calibrate
    a, b = lid.fit(clean), lid.fit(noisy)
    assert abs(a.limits[0] - b.limits[0]) < 0.5
    noise = [" ".join("".join(rng.choices("qxjkvwzpbgfm", k=rng.randint(3, 9))) for _ in range(60)) for _ in range(10)]
    assert all(rejected for _, _, rejected in lid._score(b, noise))
    assert not any(rejected for _, _, rejected in lid._score(b, texts("xx", 200, 77)))


def test_languages_of_long_texts_are_learned(docs_frame):
    long = [(1000 + i, t, "zz", None) for i, t in enumerate(texts("zz", 40, 8, 400, 500))]
    long += [(1100, "9" * 5000 + " что это", "zz", None)]
    docs = docs_frame([r for r in rows() if r[2] != "zz"] + long)
    sample = lid.training_sample(docs, 400, 1000)
    assert len(sample["zz"]) == 41 and max(map(len, sample["zz"])) <= 1000
    assert "что это" in sample["zz"]
    whole = {r[1] for r in long}
    assert all(any(t in w for w in whole) for t in sample["zz"]) and not all(any(w.startswith(t) for w in whole) for t in sample["zz"])
    few = lid.training_sample(docs, 20, 1000)
    assert all(len(t) == 20 for t in few.values()) and set(few["xx"]) <= {r[1] for r in rows()}
    model = lid.fit(sample)
    assert [(lang, rejected) for lang, _, rejected in lid._score(model, texts("zz", 5, 70, 400, 500))] == [("zz", False)] * 5


def test_odd_rows(docs_frame):
    odd = [(2000, None, "xx", None), (2001, "", "yy", None), (2002, "123 $$$ \n", "xx", None), (None, "the of and", "xx", None), (2003, "a", None, None),
           (2004, "the of " * 400_000, None, None), (2005, "😀 the".encode("utf-16", "surrogatepass").decode("utf-16"), None, None)]
    found = {r["doc_id"]: r for r in lid.language_report(docs_frame(rows(40) + odd)).collect()}
    for i in (2000, 2001, 2002):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[2004]["lang_pred"] == "xx" and found[None]["held_out"] is False
    assert lid.language_report(docs_frame([])).collect() == []
    assert lid.language_report(docs_frame([(1, "some text", None, None)])).first()["lang_pred"] == "und"


@pytest.fixture(scope="module")
def model():
    return lid.fit({lang: texts(lang, 40, k) for k, lang in enumerate(WORDS)})


def test_probabilities_sum_to_one():
    alphabet = [ord(c) for c in "ab"] + [lid.SPACE]
    fitted = lid.fit({"a": ["ab ba abab bba", "aab b a", "abba", "b", "ba ab", "aa", "bb", "ab", "ba"]})
    for past in ("   ", "  a", " ab", "bba", "ab ", "aaa"):
        total = sum(math.exp(float(fitted.signs_logs(np.array([*map(ord, past), c], np.uint64))[0, 0])) for c in alphabet)
        assert total <= 1.0 + 1e-4
        assert total > 0.85


def test_scores_do_not_depend_on_the_batch(model, monkeypatch):
    many = texts("xx", 20, 5) + texts("yy", 20, 6) + ["", None, "x"]
    together = list(lid._score(model, many))
    alone = [next(lid._score(model, [t])) for t in many]
    monkeypatch.setattr(lid, "CHUNK", 50)
    cut = list(lid._score(model, many))
    for a, b, c in zip(together, alone, cut, strict=True):
        assert a[0] == b[0] == c[0] and a[1] == pytest.approx(b[1]) == pytest.approx(c[1])


class PlainModel:
    """Kneser-Ney over strings in dicts, by the recursive formula."""

    def __init__(self, padded, alphabet):
        seen = [{}, {}, {}, {}]
        for text in padded:
            for k in range(4):
                for i in range(len(text) - k):
                    gram = text[i:i + k + 1]
                    seen[k][gram] = seen[k].get(gram, 0) + 1
        self.alphabet, self.counts = alphabet, [*[{g: sum(x[1:] == g for x in seen[k + 1]) or 1 for g in seen[k]} for k in range(3)], seen[3]]
        self.discounts, self.heads = [], []
        for counts in self.counts:
            once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
            self.discounts.append(once / (once + 2 * twice) if once and twice else 0.5)
            heads = {}
            for g, c in counts.items():
                kinds, total = heads.get(g[:-1], (0, 0))
                heads[g[:-1]] = kinds + 1, total + c
            self.heads.append(heads)

    def p(self, gram):
        k = len(gram) - 1
        shorter = self.p(gram[1:]) if k else 1 / self.alphabet
        if gram[:-1] not in self.heads[k]:
            return shorter
        kinds, total = self.heads[k][gram[:-1]]
        d = self.discounts[k]
        return max(self.counts[k].get(gram, 0) - d, 0) / total + d * kinds / total * shorter


def padded(text):
    return "   " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_plain_kneser_ney(seed):
    rng = random.Random(seed)
    signs = {"a": "abc d,", "b": "bcde  é-", "c": "aeхц 1"}
    samples = {x: ["x" + "".join(rng.choices(s, k=rng.randint(1, 60))) for _ in range(25)] for x, s in signs.items()}
    fitted = lid.fit(samples)
    alphabet = len({c for each in samples.values() for t in each for c in padded(t)}) + 1
    plain = [PlainModel([padded(t) for i, t in enumerate(samples[x]) if i % lid.FOLDS], alphabet) for x in sorted(samples)]
    probes = ["".join(rng.choices("abcde éхц1,ñ", k=rng.randint(1, 80))) + "a" for _ in range(30)]
    for probe, (lang, score, _) in zip(probes, lid._score(fitted, probes), strict=True):
        text = padded(probe)
        want = np.array([[math.log(m.p(text[i - 3:i + 1])) for m in plain] for i in range(3, len(text))])
        np.testing.assert_allclose(fitted.signs_logs(lid.codes(probe)), want, atol=2e-4)
        entropy = -want.mean(0)
        weights = np.exp(-lid.SHARPNESS * (entropy - entropy.min()))
        assert score == pytest.approx(1 / weights.sum(), abs=5e-3)
        if np.diff(np.sort(entropy))[0] > 1e-3:
            assert lang == sorted(samples)[int(entropy.argmin())]
