from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logprism.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def read(spark, rows):
    formatted = chat.format_chats(chat.canonical_turns(turns(spark, rows)))
    return {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "<s", "<<s>>", "[\\INST]", "", "a\nb", "é\U0001f600</s>", "[/INST]</s><s>user[INST] x", "<s>" * 50]


def test_control_strings_come_back(spark):
    rows = [(i, k, role, text) for i, text in enumerate(NASTY) for k, role in enumerate(("system", "user", "assistant", "to</s>ol"))]
    got = read(spark, rows)
    for i, text in enumerate(NASTY):
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [(r, text) for r in ("system", "user", "assistant", "to</s>ol")]
        assert got[i]["learned"] == text


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(alphabet="<s>/[INST]\\ é\n", max_size=30)), min_size=1, max_size=8))
def test_round_trip(spark, said):
    got = read(spark, [(1, k, role, text) for k, (role, text) in enumerate(said)])[1]
    assert [tuple(t) for t in got["turns"]] == said
    assert got["learned"] == "".join(t for r, t in said if r == "assistant")
    spans = [got["formatted"][x["start"]:x["end"]] for x in got["loss"]]
    assert "".join(spans).count("</s>") == 0
    assert len(spans) == sum(r == "assistant" for r, _ in said)


def test_nulls_ties_and_empty(spark):
    got = read(spark, [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", "b"), (None, 1, "user", "x"), (None, 1, "user", "x")])
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "b")]
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "x")] * 2
    assert read(spark, []) == {}


def canonical(spark, schema, rows):
    found = chat.canonical_turns(spark.createDataFrame(rows, schema)).orderBy("conv_id", "turn").collect()
    return [(r["conv_id"], r["role"], r["text"]) for r in found]


def test_layouts_in_one_table(spark):
    schema = ("conv_id long, messages array<struct<role: string, content: string, name: string>>, conversations array<struct<from: string, value: string>>,"
              " instruction string, input string, output string, prompt string, response string, completion string, source string")
    rows = [
        (1, [("user", "q", "n"), ("assistant", None, None)], None, None, None, None, None, None, None, "s"),
        (2, None, [("human", "q"), ("gpt", "a")], None, None, None, None, None, None, None),
        (3, None, None, "do", "it", "done", None, None, None, "s"),
        (4, None, None, "do", "", None, None, None, None, "s"),
        (5, None, None, None, None, None, "p", "r", None, "s"),
        (6, None, None, None, None, None, "p", None, "c", "s"),
        (7, None, None, None, None, None, None, None, None, "s"),
        (8, [("user", "q", None)], None, "both", None, None, None, None, None, "s"),
    ]
    assert canonical(spark, schema, rows) == [
        (1, "user", "q"), (1, "assistant", ""), (2, "user", "q"), (2, "assistant", "a"), (3, "user", "do\nit"), (3, "assistant", "done"),
        (4, "user", "do"), (4, "assistant", ""), (5, "user", "p"), (5, "assistant", "r"), (6, "user", "p"), (6, "assistant", "c"),
        (7, None, None), (8, None, None)]


def test_layouts_have_different_fingerprints():
    prints = [p for layout in chat.LAYOUTS for p in layout.fingerprints() if p]
    assert len(prints) == len(set(prints))


def test_query_has_no_python(spark, sf_dir):
    from logprism.llm.catalog import QUERIES

    plan = QUERIES["op3_chat_format"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unescape_is_left_to_right(spark):
    row = spark.range(1).select(chat.unescape(chat.escape(F.lit("\\<s>\\"))).alias("x")).first()
    assert row["x"] == "\\<s>\\"
