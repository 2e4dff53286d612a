import random
from collections import defaultdict

from logprism.llm import line_dedup


def brute(rows):
    places = defaultdict(set)
    for d, t in rows:
        if t is not None:
            lines = t.split("\n")
            for i in range(len(lines) - 2):
                w = tuple(lines[i:i + 3])
                if any(x.strip("\x20\x09\x0a\x0b\x0c\x0d") for x in w):
                    places[w].add((d is None, d or 0, i))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i:i + 3])
            if w in places and min(places[w]) != (d is None, d or 0, i):
                gone |= {i, i + 1, i + 2}
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def run(docs):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["removed_lines"]) for r in line_dedup.dedup_report(docs).collect()), key=str)


def test_against_brute_force(docs_frame):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", f"own {i} {k}", "long line"]) for k in range(rng.randint(0, 12)))) for i in range(200)]
    passage = "one\ntwo\nthree\nfour"
    rows += [(500 + i, f"start {i}\n{passage}\nend {i}") for i in range(50)]
    rows += [(600, rows[3][1]), (601, f"{passage}\n{passage}")]
    assert run(docs_frame([(*r, None, None) for r in rows])) == brute(rows)


def test_odd_rows(docs_frame):
    rows = [(1, None), (2, ""), (3, "\n\n\n\n"), (4, "a\nb"), (5, "a\nb"), (None, "x\ny\nz"), (6, "x\ny\nz"), (7, "a\r\nb\r\nc"), (8, "q\n" * 5000), (9, "p")]
    assert run(docs_frame([(*r, None, None) for r in rows])) == brute(rows)
    assert run(docs_frame([])) == []
    twice = run(docs_frame([(1, "x\ny\nz", None, None)] * 2))
    assert [r[3] for r in twice] == [0, 0]  # equal rows of one id both count as the first


def test_columns_stay_and_there_is_no_python(spark, docs_frame):
    docs = docs_frame([(1, "x\ny\nz", "en", "s")]).selectExpr("*", "1 AS starts", "2 AS id", "3 AS hash", "4 AS text_hash", "5 AS row")
    done = line_dedup.dedup_lines(docs)
    assert done.select("row.*").columns == docs.columns
    assert done.first()["row"]["starts"] == 1
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
