import numpy as np

from logprism.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def brute(rows):
    rows = [(i, x, lab) for i, x, lab in rows]
    ok = {k: np.array(x, np.float32).astype(float) for k, (i, x, lab) in enumerate(rows)
          if i is not None and lab is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)}
    links = {k: [m for m in ok if m != k and rows[m][2] == rows[k][2] and len(ok[m]) == len(ok[k])
                 and ok[k] @ ok[m] / np.linalg.norm(ok[k]) / np.linalg.norm(ok[m]) >= 0.93] for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(links.get(k, [])), min((rows[m][0] for m in seen), default=None) if i is not None else None))
    return sorted(out, key=str)


def run(spark, rows):
    found = embedding_dedup.embedding_report(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA)).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)  # so that groups are cut into blocks
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24).tolist(), int(i % 3)) for i in range(200)]
    base = rng.normal(size=24)
    rows += [(300 + i, (base + rng.normal(size=24) * 0.12).tolist(), 1) for i in range(150)]  # a dense group
    rows += [(500 + i, rows[7][1], 1) for i in range(60)] + [(600, rows[7][1], 2), (601, rows[7][1], None)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [1.0, 0.0], None), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [], 1),
            (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1e-30, 0.0], 1), (10, [3e38, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 2)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_recall_of_buckets_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    x, y = embedding_dedup.buckets(a), embedding_dedup.buckets(b)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() > 0.99


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = embedding_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(embedding_dedup.hadamard(y), x)
