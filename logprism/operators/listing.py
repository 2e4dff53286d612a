"""Listings, searches and dashboard figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logprism.functions.text import utrim_end

TAIL_LINES = 200
PAGE_ROWS = 50
MAX_PAGE_ROWS = 200
DASHBOARD_CRITICALS = 5

# The severities counted on the dashboard.
DASHBOARD_SEVERITIES = ("critical", "warning", "info", "normal")


def log_tail(lines: DataFrame, order: list[str], n: int = TAIL_LINES) -> DataFrame:
    """The last ``n`` lines, right-trimmed, oldest first."""
    last = lines.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.withColumn("line", utrim_end(F.col("line"))).orderBy(*order)


def sample_targets(samples: DataFrame) -> DataFrame:
    return samples.select("target_id").distinct().orderBy("target_id")


def _page(
    rows: DataFrame, newest: str, key: str, limit: int, page: int, after: tuple[datetime, object] | None = None
) -> DataFrame:
    """Rows of one page, found by time and key alone; their texts come in at the end.

    ``after``, the time and key of the last row seen, starts right behind it, so a deep
    page costs no more than the first.
    """
    keys = rows.select(newest, key)
    if after is not None:
        moment, last = F.lit(after[0]), F.lit(after[1])
        keys = keys.where((F.col(newest) < moment) | ((F.col(newest) == moment) & (F.col(key) > last)))
        page = 0
    wanted = keys.orderBy(F.desc(newest), key).offset(page * limit).limit(limit)
    found = rows.join(wanted.distinct(), [newest, key], "left_semi").select(*rows.columns)
    return found.orderBy(F.desc(newest), key).limit(limit)


def _of_target(rows: DataFrame, target_id: str | None) -> DataFrame:
    return rows if target_id is None else rows.where(F.col("target_id") == target_id)


def samples_page(
    samples: DataFrame,
    target_id: str | None = None,
    limit: int = PAGE_ROWS,
    page: int = 1,
    after: tuple[datetime, str] | None = None,
) -> DataFrame:
    """One page of samples, newest first. Pages count from 1; 0 is the first too.
    ``after`` (time and key of the last row seen) asks for the page behind it instead."""
    return _page(_of_target(samples, target_id), "timestamp", "sample_hash", limit, max(page, 1) - 1, after)


def page_total(rows: DataFrame, target_id: str | None = None) -> DataFrame:
    """How many rows the pages of a listing have together: one row ``total``."""
    return _of_target(rows, target_id).agg(F.count("*").alias("total"))


def classifications_page(
    classifications: DataFrame,
    target_id: str | None = None,
    limit: int = PAGE_ROWS,
    page: int = 0,
    after: tuple[datetime, str] | None = None,
) -> DataFrame:
    """One page of classifications, newest first. Pages count from 0; the number of
    rows is kept between 1 and 200."""
    rows = min(max(limit, 1), MAX_PAGE_ROWS)
    return _page(_of_target(classifications, target_id), "classified_at", "sample_hash", rows, page, after)


def classification_by_hash(classifications: DataFrame, sample_hash: str) -> DataFrame:
    return classifications.where(F.col("sample_hash") == sample_hash)


def by_severity(page: DataFrame, severity: str) -> DataFrame:
    """The rows of a page that have one exact severity."""
    return page.where(F.col("severity") == severity)


def tracking_matches(logs: DataFrame, search: str = "", level: str = "") -> DataFrame:
    """Tracking records of one exact level whose message matches a pattern in any case."""
    found = logs.where(F.col("level") == level) if level else logs
    return found.where(F.col("message").rlike("(?iu)" + search)) if search else found


def tracking_search(
    logs: DataFrame,
    search: str = "",
    level: str = "",
    limit: int = PAGE_ROWS,
    page: int = 0,
    key: str = "id",
    after: tuple[datetime, object] | None = None,
) -> DataFrame:
    """One page of matching tracking records, newest first. Pages count from 0."""
    return _page(tracking_matches(logs, search, level), "timestamp", key, limit, page, after)


def _latest(classifications: DataFrame, latest: int | None) -> DataFrame:
    if latest is None:
        return classifications
    return classifications.orderBy(F.desc("classified_at"), "sample_hash").limit(latest)


def severity_counts(classifications: DataFrame, latest: int | None = None) -> DataFrame:
    """Counts per severity, zeros included; of the ``latest`` classifications only, if given."""
    return _latest(classifications.select("severity", "classified_at", "sample_hash"), latest).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in DASHBOARD_SEVERITIES]
    )


def recent_criticals(
    classifications: DataFrame, n: int = DASHBOARD_CRITICALS, latest: int | None = None
) -> DataFrame:
    """The newest ``n`` critical classifications; among the ``latest`` only, if given."""
    critical = by_severity(_latest(classifications, latest), "critical")
    return critical.orderBy(F.desc("classified_at"), "sample_hash").limit(n)


def line_class(line: Column) -> Column:
    """How a viewer tints a line: error, warn, debug or info."""
    low = F.lower(line)
    return (
        F.when(low.contains("error") | low.contains("err "), F.lit("error"))
        .when(low.contains("warn"), F.lit("warn"))
        .when(low.contains("debug"), F.lit("debug"))
        .otherwise(F.lit("info"))
    )


def filter_lines(lines: DataFrame, text: str = "") -> DataFrame:
    """Lines that hold ``text`` in any case, with their ``class``."""
    found = lines.where(F.lower("line").contains(text.lower())) if text else lines
    return found.withColumn("class", line_class(F.col("line")))


def size_label(size: Column) -> Column:
    """A byte count for people: B, or KB and MB with one decimal; a dash for null."""
    def one_decimal(value: Column, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", value), F.lit(unit))

    return (
        F.when(size.isNull(), F.lit("—"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1024 * 1024, one_decimal(size / 1024, "KB"))
        .otherwise(one_decimal(size / 1024 / 1024, "MB"))
    )
