"""Scan for language-model and agent activity."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.arrays import ratio
from logprism.functions.plan import computed_once
from logprism.functions.signal_table import SIGNALS, Signal
from logprism.functions.text import fold_case_variants, is_blank, java_regex
from logprism.operators.lines import with_lines

WORTH_SCORE = 0.02


def _matches(signal: Signal, folded: Column, low: Column) -> Column:
    near = reduce(or_, [F.contains(low, F.lit(needle)) for needle in signal.needles])
    return near & folded.rlike(java_regex(signal.pattern))


def signal_bits(folded: Column, low: Column) -> Column:
    """All signals of one line as bits of an int, in table order."""
    flags = [
        F.when(_matches(signal, folded, low), F.lit(1 << i)).otherwise(F.lit(0))
        for i, signal in enumerate(SIGNALS)
    ]
    return reduce(lambda a, b: a + b, flags)


def with_signals(df: DataFrame, threshold: float = WORTH_SCORE) -> DataFrame:
    """Add the struct ``agentic_scan`` to a frame that has ``lines``.

    Unlike the other stages this reads every line of the sample. Each line is
    tested once; which signals it showed is kept as an int. The first hits and counts
    come from the array of the ints that are not zero, in line order.
    """
    texts = F.transform(F.filter("lines", lambda x: ~is_blank(x)), fold_case_variants)
    pairs = F.transform(texts, lambda x: F.struct(x.alias("folded"), F.lower(x).alias("low")))
    hits = F.transform(pairs, lambda p: signal_bits(p.folded, p.low))
    scanned = df.withColumn("_all", hits).select(
        "*", F.filter("_all", lambda h: h != 0).alias("_hits"), F.size("_all").alias("_total")
    )
    flagged = F.size("_hits").cast("bigint")

    # One pass keeps the lines that show a signal for the first time, 20 at most.
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("line"), F.array().cast("array<struct<line:int,bits:int>>").alias("new"))

    def step(state: Column, hit: Column) -> Column:
        line, fresh = state.line + 1, hit.bitwiseAND(F.bitwise_not(state.seen))
        added = F.when(fresh == 0, state.new).otherwise(F.array_append(state.new, F.struct(line.alias("line"), fresh.alias("bits"))))
        return F.struct(state.seen.bitwiseOR(hit).alias("seen"), line.alias("line"), added.cast("array<struct<line:int,bits:int>>").alias("new"))

    scanned = scanned.withColumn("_new", F.aggregate("_hits", start, step, lambda state: state.new))

    def first_line(bit: int) -> Column:
        shown = F.get(F.filter("_new", lambda x: x.bits.bitwiseAND(bit) != 0), F.lit(0))
        return F.coalesce(shown.line, F.lit(0))

    found = signals_found([first_line(1 << i) for i in range(len(SIGNALS))])
    scanned = scanned.withColumn("_found", found)
    scanned = scanned.withColumn(
        "agentic_scan", scan_struct(F.col("_found"), flagged, F.col("_total"), threshold)
    ).drop("_all", "_hits", "_new", "_total", "_found")
    return computed_once(scanned)


def signals_found(first_lines: list[Column]) -> Column:
    """The signals that were shown, in order of their first line; lines count from 1, 0
    stands for none."""
    firsts = [
        F.struct(
            line.alias("line"),
            F.lit(i).alias("rank"),
            F.lit(signal.label).alias("label"),
            F.lit(signal.framework).cast("string").alias("framework"),
        )
        for i, (signal, line) in enumerate(zip(SIGNALS, first_lines))
    ]
    return F.array_sort(F.filter(F.array(*firsts), lambda s: s.line > 0))


def scan_struct(found: Column, flagged: Column, total: Column, threshold: float) -> Column:
    """The struct ``agentic_scan`` of the signals found and of the counts of lines."""
    score = ratio(flagged, total)
    return F.struct(
        score.alias("signal_score"),
        (score >= threshold).alias("worth_classifying"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda s: s.framework)))).alias("detected_frameworks"),
        F.transform(found, lambda s: s.label).alias("matched_patterns"),
        flagged.alias("agentic_line_count"),
    )


def signal_scan(samples: DataFrame, threshold: float = WORTH_SCORE) -> DataFrame:
    """Score and line count per sample."""
    return with_signals(with_lines(samples), threshold).select(
        "sample_hash",
        "agentic_scan.signal_score",
        "agentic_scan.worth_classifying",
        "agentic_scan.agentic_line_count",
    )


def signal_patterns(samples: DataFrame) -> DataFrame:
    """Matched patterns in order of first hit: ``sample_hash, position, pattern``."""
    scan = with_signals(with_lines(samples))
    rows = scan.select(
        "sample_hash", F.posexplode("agentic_scan.matched_patterns").alias("position", "pattern")
    )
    return rows.withColumn("position", F.col("position").cast("bigint"))


def signal_frameworks(samples: DataFrame) -> DataFrame:
    scan = with_signals(with_lines(samples))
    return scan.select("sample_hash", F.explode("agentic_scan.detected_frameworks").alias("framework"))


def signal_pattern_hits(samples: DataFrame) -> DataFrame:
    """How many lines each pattern matches, per pattern over all samples.

    Counts are combined on the map side; at most one row per pattern and task is
    shuffled.
    """
    # Without the barrier the filter that explode infers would split the texts again.
    lines = computed_once(with_lines(samples).select("lines")).select(F.explode("lines").alias("line"))
    pairs = lines.select(fold_case_variants(F.col("line")).alias("folded")).select(
        "folded", F.lower("folded").alias("low")
    )
    counts = [
        F.count_if(_matches(signal, F.col("folded"), F.col("low"))).alias(signal.label)
        for signal in SIGNALS
    ]
    one_row = pairs.agg(*counts)
    return one_row.unpivot([], [s.label for s in SIGNALS], "pattern", "hit_lines")
