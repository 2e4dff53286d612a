"""Format detection: which structure does a sample's text have?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.arrays import count_where, ratio
from logprism.functions.plan import computed_once
from logprism.functions.text import NON_SPACE, SPACE, tokens
from logprism.operators.lines import first_items, with_lines

PLAIN = "plain_text"

# The field names that play each role.
TIMESTAMP_KEYS = ("time", "timestamp", "ts", "@timestamp", "date", "datetime")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl", "loglevel")
MESSAGE_KEYS = ("message", "msg", "text", "body", "log")
# What a syslog line may start with.
SYSLOG_STARTS = r"^(<|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

# Two tokens with "=" in them: after the first "=", white space and another "=".
TWO_PAIRS = rf"(?s)^(?!\{{)[^=]*+={NON_SPACE}*+{SPACE}[^=]*+="
# A quoted string and, if it is a key, the colon behind it. Possessive, so a long
# string cannot exhaust the matcher's stack.
_QUOTED = rf'(?s)("(?:\\.|[^"\\])*+"{SPACE}*+:?)'

FORMAT_TYPE = (
    "struct<log_type:string,timestamp_field:string,level_field:string,message_field:string,"
    "timestamp_format:string,multiline:boolean>"
)


def with_probe(df: DataFrame, probe_lines: int | None = None) -> DataFrame:
    """Add ``probe``: the trimmed lines that tell the format, by default all."""
    return df.withColumn("probe", first_items(F.col("trimmed"), probe_lines))


def with_scores(df: DataFrame) -> DataFrame:
    """Add the share of probe lines that look like each format.

    The share of continuation lines is taken over all lines, untrimmed, and is 0
    for samples of fewer than four lines.
    """
    probe, lines = F.col("probe"), F.col("lines")
    n = F.size(probe)
    indented = F.size(F.filter(lines, lambda x, i: (i > 0) & x.rlike(r"^(  |\t)")))
    return df.select(
        "*",
        ratio(
            count_where(probe, lambda x: x.startswith("{") & x.endswith("}")), n
        ).alias("json_score"),
        ratio(count_where(probe, lambda x: x.rlike(TWO_PAIRS)), n).alias("logfmt_score"),
        ratio(count_where(probe, lambda x: x.rlike(SYSLOG_STARTS)), n).alias("syslog_score"),
        F.when((n > 0) & (F.size(lines) >= 4), ratio(indented, F.size(lines)))
        .otherwise(F.lit(0.0))
        .alias("multiline_score"),
    )


def with_log_type(scored: DataFrame) -> DataFrame:
    """Add ``log_type``, the vote of the scores, to a frame that has them."""
    # Equal scores go to the later format, hence the rank inside the struct.
    names = ("json", "logfmt", "syslog", "multiline")
    votes = [
        F.struct(F.col(f"{name}_score").alias("score"), F.lit(rank).alias("rank"), F.lit(name).alias("name"))
        for rank, name in enumerate(names)
    ]
    return scored.withColumn("_vote", F.array_max(F.array(*votes))).withColumn(
        "log_type", F.when(F.col("_vote.score") > 0.5, F.col("_vote.name")).otherwise(F.lit(PLAIN))
    ).drop("_vote")


def format_struct(log_type: Column, roles: Column) -> Column:
    """The struct ``format`` of a log type and of the names found for its roles."""
    syslog = log_type == "syslog"
    return F.struct(
        log_type.alias("log_type"),
        F.when(syslog, F.lit("timestamp")).otherwise(roles.ts).alias("timestamp_field"),
        F.when(syslog, F.lit("severity")).otherwise(roles.level).alias("level_field"),
        F.when(syslog, F.lit("message")).otherwise(roles.msg).alias("message_field"),
        F.lit(None).cast("string").alias("timestamp_format"),
        (log_type == "multiline").alias("multiline"),
    )


def with_format(df: DataFrame, probe_lines: int | None = None) -> DataFrame:
    """Add ``log_type`` and the struct ``format`` to a frame that has lines."""
    voted = with_log_type(with_scores(with_probe(df, probe_lines)))
    roles = computed_once(voted).withColumn("_roles", _roles(F.col("log_type"), F.col("probe")))
    detected = roles.withColumn("format", format_struct(F.col("log_type"), F.col("_roles"))).drop("_roles")
    return computed_once(detected)


def json_keys(line: Column) -> Column:
    """The quoted names before a colon in a line, at any depth."""
    quoted = F.regexp_extract_all(line, F.lit(_QUOTED), 1)
    keys = F.filter(quoted, lambda q: q.endswith(":"))
    return F.transform(keys, lambda q: F.regexp_extract(q, r'(?s)^"(.*)"', 1))


def logfmt_keys(line: Column) -> Column:
    return F.transform(tokens(line), lambda t: F.substring_index(t, "=", 1))


def roles_among(keys: Column) -> Column:
    """The first of the keys for each role, as ``struct<ts, level, msg>``."""

    def first_of(known: tuple[str, ...]) -> Column:
        return F.get(F.filter(keys, lambda k: F.lower(k).isin(*known)), F.lit(0))

    return F.struct(
        first_of(TIMESTAMP_KEYS).alias("ts"), first_of(LEVEL_KEYS).alias("level"), first_of(MESSAGE_KEYS).alias("msg")
    )


def any_role(roles: Column) -> Column:
    return F.coalesce(roles.ts, roles.level, roles.msg).isNotNull()


def _roles(log_type: Column, probe: Column) -> Column:
    """Names of the time, level and message fields, from the first probe line that
    has any of them."""

    def hits(keys_of) -> Column:
        found = F.transform(F.transform(probe, keys_of), roles_among)
        return F.get(F.filter(found, any_role), F.lit(0))

    return F.when(log_type == "json", hits(json_keys)).when(log_type == "logfmt", hits(logfmt_keys))


def format_scores(samples: DataFrame, probe_lines: int | None = None) -> DataFrame:
    return with_scores(with_probe(with_lines(samples), probe_lines)).select(
        "sample_hash", "json_score", "logfmt_score", "syslog_score", "multiline_score"
    )


def format_detect(samples: DataFrame, probe_lines: int | None = None) -> DataFrame:
    """``sample_hash`` and the fields of ``format``."""
    return with_format(with_lines(samples), probe_lines).select("sample_hash", "format.*")
