"""Severity words and how they are found in each kind of log line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logprism.functions.text import NON_SPACE, SPACE, utrim

# Level words and the label each stands for, in lookup order.
LEVEL_WORDS = (
    ("debug", "debug"),
    ("dbg", "debug"),
    ("trace", "trace"),
    ("trc", "trace"),
    ("info", "info"),
    ("information", "info"),
    ("inf", "info"),
    ("notice", "notice"),
    ("warn", "warn"),
    ("warning", "warn"),
    ("wrn", "warn"),
    ("error", "error"),
    ("err", "error"),
    ("critical", "critical"),
    ("crit", "critical"),
    ("fatal", "fatal"),
    ("alert", "alert"),
    ("emergency", "emergency"),
    ("emerg", "emergency"),
)

# The ten labels, the keys that carry a level, and the syslog
# severities 0 to 7.
LABELS = tuple(dict.fromkeys(label for _, label in LEVEL_WORDS))
JSON_LEVEL_KEYS = ("level", "severity", "lvl", "log_level")
LOGFMT_LEVEL_KEYS = ("level", "lvl", "severity", "log_level")
SYSLOG_LABELS = ("emergency", "alert", "critical", "error", "warn", "notice", "info", "debug")


def label_of(word: Column) -> Column:
    """The label of a bare level word (quotes and white space around it ignored)."""
    bare = F.lower(F.trim(utrim(word), F.lit('"')))
    words = F.create_map(*[F.lit(x) for pair in LEVEL_WORDS for x in pair])
    return F.try_element_at(words, bare)


def json_level(line: Column) -> Column:
    """Level of a JSON line: the first level key whose value is a known word.

    Per key only its first occurrence counts, so the value is read from the text
    right after it instead of by one pattern that could move on to a later one.
    """

    def by_key(name: str) -> Column:
        quoted = f'"{name}"'
        at = F.instr(line, quoted)
        rest = F.substr(line, at + len(quoted))
        in_quotes = F.regexp_extract(rest, rf'^{SPACE}*+:{SPACE}*+"([^"]*)', 1)
        bare = F.regexp_extract(rest, rf"^{SPACE}*+:{SPACE}*+([^,}} \"][^,}} ]*)", 1)
        return F.when(at > 0, F.coalesce(label_of(in_quotes), label_of(bare)))

    return F.coalesce(*[by_key(name) for name in JSON_LEVEL_KEYS])


def logfmt_level(line: Column) -> Column:
    """Level of a logfmt line: its first level token decides, known word or not."""
    keys = "|".join(LOGFMT_LEVEL_KEYS)
    return label_of(F.regexp_extract(line, f"(?<!{NON_SPACE})(?i:{keys})=({NON_SPACE}*)", 1))


def plain_level(low: Column) -> Column:
    """Level of lower-case free text: ``[WORD]``, ``WORD:``, `` WORD `` or a leading
    ``WORD``. The first label in table order wins, wherever its word stands."""

    def mentions(label: str) -> Column:
        words = [word for word, of in LEVEL_WORDS if of == label]
        stems = [w for w in words if not any(o != w and o in w for o in words)]
        near = _any_of([F.contains(low, F.lit(stem)) for stem in stems])
        forms = [
            F.contains(low, F.lit(form))
            for word in words
            for form in (f"[{word}]", f"{word}:", f" {word} ")
        ]
        forms += [F.startswith(low, F.lit(word)) for word in words]
        return near & _any_of(forms)

    return F.coalesce(*[F.when(mentions(label), F.lit(label)) for label in LABELS])


def syslog_level(line: Column, low: Column, plain: Column | None = None) -> Column:
    """Level of a syslog line, also given in lower case: from its ``<priority>``, else
    as free text; ``plain`` is its level as that, where it is known."""
    priority = F.regexp_extract(line, r"^<(\+?\d+)>", 1).try_cast("int")
    severity = F.get(F.array(*map(F.lit, SYSLOG_LABELS)), priority.bitwiseAND(7))
    return F.when(priority <= 255, severity).otherwise(plain_level(low) if plain is None else plain)


def _any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result
