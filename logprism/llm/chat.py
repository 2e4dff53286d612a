"""Chat formatting: layouts are told apart by a fingerprint of their nested fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Control strings of the template; texts and roles never hold them unescaped.
START, TEXT, TEXT_END, END = "<s>", "[INST] ", " [/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """A declared layout: the paths it needs, the paths it may have, its first column, its turns.

    Paths are written as ``messages[].role``. ``turns`` makes the turns from a function
    that gives the column of a top-level field (null where the input lacks it). A table
    without ``column`` cannot have the layout.
    """

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...]
    column: str
    turns: Callable[[Callable[[str], Column]], Column]

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield "\n".join(sorted(self.needed + some))


def _turn(at: Column, role: Column, text: Column) -> Column:
    return F.struct(at.cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _listed(name: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda field: F.transform(field(name), lambda x, i: _turn(i, x[role], x[text]))


def _prompt(prompt: str, reply: str, more: str = "", system: str = "") -> Callable[[Callable[[str], Column]], Column]:
    def turns(field: Callable[[str], Column]) -> Column:
        asked = F.concat_ws("\n", field(prompt), F.when(field(more) != "", field(more))) if more else field(prompt)
        pair = F.array(_turn(F.lit(1), F.lit("user"), asked), _turn(F.lit(2), F.lit("assistant"), field(reply)))
        if not system:
            return pair
        first = F.array(_turn(F.lit(0), F.lit("system"), field(system)))
        return F.when(field(system).isNotNull(), F.concat(first, pair)).otherwise(pair)

    return turns


# Other names of roles in such data.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _from_values(field: Callable[[str], Column]) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.transform(field("conversations"), lambda x, i: _turn(i, F.coalesce(names[x["from"]], x["from"]), x["value"]))


LAYOUTS = (
    Layout("turn rows", (), ("turn", "role", "text"), "turn", lambda f: F.array(_turn(f("turn"), f("role"), f("text")))),
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), "messages",
           _listed("messages", "role", "content")),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), "conversations", _from_values),
    Layout("instruction", ("instruction",), ("input", "output", "system"), "instruction",
           _prompt("instruction", "output", "input", "system")),
    Layout("prompt and response", ("prompt",), ("response",), "prompt", _prompt("prompt", "response")),
    Layout("prompt and completion", ("prompt", "completion"), (), "prompt", _prompt("prompt", "completion")),
)


def _present(schema: T.StructType, paths: list[str]) -> list[Column]:
    """Which of the paths a row has, as their names or null. A null field counts as missing."""
    found = []
    for path in paths:
        top, _, inner = path.partition("[]")
        if top not in schema.fieldNames():
            continue
        kind = schema[top].dataType
        if "[]" not in path:
            if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
                found.append(F.when(F.col(f"`{top}`").isNotNull(), F.lit(path)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            name = inner.removeprefix(".")
            if not name:
                found.append(F.when(F.size(f"`{top}`") > 0, F.lit(path)))
            elif name in kind.elementType.fieldNames():
                found.append(F.when(F.exists(f"`{top}`", lambda x: x[name].isNotNull()), F.lit(path)))  # noqa: B023
    return found


def _field(schema: T.StructType, layout: Layout) -> Callable[[str], Column]:
    """Gives a field, null where the input lacks it. Members of lists get all names the layout knows."""

    def column(name: str) -> Column:
        members = [p.partition("[].")[2] for p in layout.optional if p.startswith(f"{name}[].")]
        has = name in schema.fieldNames()
        if not members:
            return F.col(f"`{name}`").cast("string") if has and name != "turn" else F.col(name) if has else F.lit(None).cast("string")
        own = schema[name].dataType.elementType.fieldNames() if has else []
        return F.transform(f"`{name}`", lambda x: F.struct(
            *[(x[m].cast("string") if m in own else F.lit(None).cast("string")).alias(m) for m in members]))

    return column


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, from records of any declared layout.

    The paths that a record has (not null) and that any layout knows are hashed; the
    hash selects the layout. Other fields are ignored. A null text or role is empty. A
    record that fits no layout, or has no turns, gives one row whose role and text are
    null, so that it isn't lost.
    """
    schema, known = df.schema, sorted({p for x in layouts for p in x.needed + x.optional})
    paths = F.array_join(F.sort_array(F.array_compact(F.array(*_present(schema, known), F.lit(None).cast("string")))), "\n")
    layout_print, turns, taken = F.xxhash64(paths), F.lit(None).cast(TURNS), set()
    for layout in layouts:
        if layout.column in schema.fieldNames():
            prints = [p for p in layout.fingerprints() if p not in taken]
            taken.update(prints)
            fits = layout_print.isin(*[F.xxhash64(F.lit(p)) for p in prints])
            turns = F.when(fits, layout.turns(_field(schema, layout)).cast(TURNS)).otherwise(turns)
    rows = df.select(F.col(conv_id).alias("conv_id"), F.explode_outer(turns).alias("t"))

    def filled(name: str) -> Column:
        return F.when(F.col("t").isNotNull(), F.coalesce(f"t.{name}", F.lit(""))).alias(name)

    return rows.select("conv_id", F.col("t.turn").alias("turn"), filled("role"), filled("text"))


def escape(text: Column) -> Column:
    """Reversible: a backslash before every backslash, and after the first sign of a control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``loss`` (spans of the assistant's texts).

    Turns are rows of conv_id, turn, role and text, ordered by turn (null first), then
    role and text; a null role or text is no turn. A turn reads ``<s>role[INST] text [/INST]</s>``. Spans count code points of
    the formatted text from 0; they cover the escaped text of assistant turns, once each.
    Rows with a null conv_id are one conversation, and repeated rows are turns of their
    own. A conversation is one value of the result and is put together in one task.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    piece = F.coalesce(F.concat(F.lit(START), role, F.lit(TEXT), text, F.lit(TEXT_END + END)), F.lit(""))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy("conv_id").orderBy(*order)
    pieces = turns.withColumn("piece", piece).select(
        "conv_id", "piece",
        F.row_number().over(number).alias("no"),
        (F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length(F.concat(F.lit(START), role, F.lit(TEXT)))).alias("start"),
        F.length(text).alias("chars"), (F.col("role") == "assistant").alias("learn"))
    gathered = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct("start", (F.col("start") + F.col("chars")).alias("end"))))).alias("loss"))
    return gathered.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss")


def read_chats(chats: DataFrame) -> DataFrame:
    """Turns and learned text read back from formatted conversations: conv_id, turns, learned."""
    parts = F.filter(F.split(F.col("formatted"), F.lit(r"\Q</s>\E"), -1), lambda x: x != "")

    def turn(part: Column) -> Column:
        marked = F.regexp_extract(part, r"(?s)^<s>(.*?)\[INST\] ", 1)
        # 3 for the start, 7 before the text, 8 after it
        text = F.substring(part, F.length(marked) + 11, F.length(part) - F.length(marked) - 18)
        return F.struct(unescape(marked).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))))
    return chats.select("*", F.transform(parts, turn).alias("turns"), F.array_join(learned, "").alias("learned"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    read = read_chats(format_chats(canonical_turns(conversations)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def with_control_chat(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose two texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
 SELECT conv_id, turn, role, text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, len(text) + len(text) - len(replace(text, chr(92), '')) + (len(text) - len(replace(text, '<s>', ''))) // 3
 + (len(text) - len(replace(text, '</s>', ''))) // 4 + (len(text) - len(replace(text, '[INST]', ''))) // 6
 + (len(text) - len(replace(text, '[/INST]', ''))) // 7 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 len(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), ''))::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 sum(len(role) + chars + 22)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
