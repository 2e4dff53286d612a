"""Log tables in Spark, each a function of the session and the parquet folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logprism.functions.keys import sample_hash
from logprism.functions.text import is_blank
from logprism.operators.classify import parse_replies
from logprism.plans.profile import profile

from logprism.sources.tables import read_table
from logprism.sources.targets import read_targets
from logprism.testbed import rules


# A caller with tables of few row groups may ask for so many tasks to spread their texts over.
SCAN_PARTS = "spark.logprism.scan.parts"


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    parts = spark.conf.get(SCAN_PARTS, None) if spread_by else None
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread_by, parts and int(parts))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_id, ts, event_type, line``: one log line per event."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "*", F.expr(rules.LEVEL).alias("lvl"), F.expr(rules.MESSAGE).alias("msg")
    ).select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.expr(rules.LINE).alias("line"),
    )


def _sample_rows(
    rows: DataFrame, mode: str, target: Column, file: Column, host: Column, content: Column, ts: Column
) -> DataFrame:
    named = rows.select(
        ts.cast("timestamp").alias("timestamp"),
        target.alias("target_id"),
        file.alias("source_file"),
        content.alias("sample_content"),
        host.alias("host"),
        file.alias("path"),
        F.lit(mode).alias("sampling_mode"),
    )
    return named.select(
        "*",
        (F.char_length("sample_content") - F.char_length(F.replace("sample_content", F.lit("\n"), F.lit(""))))
        .cast("bigint")
        .alias("line_count"),
        F.octet_length("sample_content").cast("bigint").alias("file_size_bytes"),
        F.when(is_blank(F.col("sample_content")), "empty").otherwise("stored").alias("processing_status"),
        F.lit(None).cast("string").alias("error_details"),
    ).withColumn("sample_hash", sample_hash())


def log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per user and log segment; a segment bounds the lines of a sample."""
    segments = (
        log_lines(spark, sf_dir)
        .groupBy("user_id", F.expr(rules.SEGMENT).alias("segment"))
        .agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("rows"), F.max("ts").alias("ts"))
    )
    user = F.col("user_id").cast("string")
    text = F.array_join(F.transform("rows", lambda r: r.line), "\n")
    return _sample_rows(
        segments,
        "both",
        F.concat(F.lit("target-"), (F.col("user_id") % 10).cast("string")),
        F.concat(F.lit("/var/log/app/u"), user, F.lit("."), F.col("segment").cast("string"), F.lit(".log")),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")),
        F.when(F.col("user_id") % 29 == 0, F.lit("")).otherwise(text),
        F.col("ts"),
    )


def _clock(row_id: str) -> Column:
    return F.expr(f"{rules.EPOCH} + {row_id} * INTERVAL 1 SECOND")


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_rows(
        table(spark, sf_dir, "documents", spread_by="doc_id"),
        "first",
        F.col("source"),
        F.concat(F.lit("/srv/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")),
        F.concat(F.lit("store-"), "lang"),
        F.col("text"),
        _clock("doc_id"),
    )


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample_rows(
        table(spark, sf_dir, "pages", spread_by="page_id"), "last", F.lit("web"), F.col("url"), F.lit("crawler"), F.col("html"),
        _clock("page_id"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples: generated logs, prose and web pages."""
    logs, prose, pages = (f(spark, sf_dir) for f in (log_samples, document_samples, page_samples))
    return logs.unionByName(prose).unionByName(pages)


def user_of_file() -> Column:
    return F.regexp_extract("source_file", r"/u(\d+)\.", 1).cast("bigint")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log samples and, for a third of the users, their repeats a minute later."""
    first = log_samples(spark, sf_dir).withColumn("delivery_id", F.lit(0))
    again = first.where(user_of_file() % 3 == 0).select(
        *[c for c in first.columns if c not in ("timestamp", "delivery_id")],
        (F.col("timestamp") + F.expr("INTERVAL 60 SECOND")).alias("timestamp"),
        F.lit(1).alias("delivery_id"),
    )
    return first.unionByName(again)


def feed(documents: DataFrame) -> DataFrame:
    """Documents as deliveries to one file per source and language, a third of them
    sent twice. Works on batch and streaming frames."""
    rows = documents.withColumn(
        "again", F.explode(F.expr("CASE WHEN doc_id % 3 = 0 THEN array(0, 1) ELSE array(0) END"))
    )
    return _sample_rows(
        rows,
        "first",
        F.col("source"),
        F.concat(F.lit("/feed/"), "lang"),
        F.lit("feeder"),
        F.col("text"),
        F.expr(f"{rules.EPOCH} + (doc_id + 30 * again) * INTERVAL 1 SECOND"),
    )


def raw_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents as users write them, through JSON."""
    fields = {name: F.expr(sql).alias(name) for name, sql in rules.TARGET_FIELDS.items()}
    flat = table(spark, sf_dir, "supplier").select(*fields.values())
    top = [f for f in flat.columns if not f.startswith(("conn_", "cred_")) and f not in ("auth_method", "log_paths")]
    document = F.struct(
        *top,
        F.split("log_paths", r"\|").alias("log_paths"),
        F.struct(
            F.col("conn_host").alias("server"), F.col("conn_port").alias("ssh_port"),
            F.col("conn_user").alias("user"), F.split("conn_paths", r"\|").alias("folders"),
        ).alias("connection"),
        F.struct(
            "auth_method", F.col("cred_password").alias("password"),
            F.col("cred_private_key_path").alias("private_key_file"),
        ).alias("credentials"),
    )
    return read_targets(flat.select(F.to_json(document).alias("document")))


def file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the file inventory, all valid, with connection failures."""
    number = F.expr("s_suppkey % 40")
    keys = table(spark, sf_dir, "supplier").select(number.alias("k")).distinct()
    return keys.select(
        F.concat(F.lit("src"), F.col("k").cast("string")).alias("target_id"),
        F.concat(F.lit("box-"), F.col("k").cast("string")).alias("host"),
        F.expr(
            "CASE k % 3 WHEN 0 THEN array('/data/en', '/data/fr/') WHEN 1 THEN array('/data/de', '/data/absent')"
            " ELSE array('/data/es', '/data/en/a', '/data/bare') END"
        ).alias("log_paths"),
        F.expr("CASE WHEN k % 4 = 0 THEN 2 ELSE NULL END").alias("max_files"),
        F.expr("CASE WHEN k % 19 = 7 THEN 'connection refused' ELSE NULL END").alias("connect_error"),
    )


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured directories that exist; some cannot be listed."""
    dirs = file_targets(spark, sf_dir).select("target_id", F.explode("log_paths").alias("directory"))
    denied = (F.col("directory") == "/data/de") & (F.substr("target_id", F.lit(4)).cast("int") % 7 == 1)
    return dirs.where(F.col("directory") != "/data/absent").withColumn(
        "list_error", F.when(denied, F.lit("permission denied"))
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.expr(rules.FILE_TARGET).alias("target_id"),
        F.expr(rules.FILE_PATH).alias("path"),
        F.expr(rules.FILE_SIZE).alias("size"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to sample: those on storage by document, and some that are empty, have
    vanished or failed; some ask for three lines."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("target_id"),
        F.concat(F.lit("store-"), "lang").alias("host"),
        F.concat(F.expr(rules.DOCUMENT_FILE), F.expr(
            "CASE WHEN doc_id % 23 = 0 THEN '.none' WHEN doc_id % 29 = 0 THEN '.gone' ELSE '' END")).alias("path"),
        F.expr("CASE WHEN doc_id % 23 = 0 THEN 0 ELSE octet_length(text) END").cast("bigint").alias("size"),
        F.expr("CASE WHEN doc_id % 31 = 0 THEN 'stream closed' ELSE NULL END").alias("read_error"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 3 ELSE NULL END").cast("bigint").alias("sample_line_count"),
    )


def cycle_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target documents for the files on storage: one per source, and the two log hosts."""
    sources = table(spark, sf_dir, "documents").select(
        F.col("source").alias("target_id"), F.expr("array('/srv/en', '/srv/fr/', '/srv/nowhere')").alias("log_paths")
    ).distinct()
    hosts = spark.range(2).select(
        F.concat(F.lit("log-"), F.col("id").cast("string")).alias("target_id"), F.expr("array('/var/log')").alias("log_paths")
    )
    document = F.struct(
        F.concat(F.lit("doc-"), "target_id").alias("document_id"), "target_id", F.lit("active").alias("status"),
        F.concat(F.lit("host-"), "target_id").alias("host"), F.lit("ops").alias("username"), "log_paths",
    )
    return read_targets(sources.unionByName(hosts).select(F.to_json(document).alias("document")))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the log samples, three quarters of them stored, with mixed versions
    and states."""
    k = F.col("k")
    logs = log_samples(spark, sf_dir).withColumn("k", user_of_file()).where(k % 4 != 3)
    rows = profile(logs, analyzed_at=F.col("timestamp"), keep=("k",))
    return rows.select(
        *[c for c in rows.columns if c not in ("k", "preprocessing_version", "classification_status")],
        F.expr("CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END").alias("preprocessing_version"),
        F.expr(
            "CASE k % 6 WHEN 1 THEN 'classified' WHEN 3 THEN 'failed' ELSE 'pending' END"
        ).alias("classification_status"),
    )


def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, versions and states of ``metadata`` without profiling anything."""
    k = F.col("k")
    logs = log_samples(spark, sf_dir).withColumn("k", user_of_file()).where(k % 4 != 3)
    return logs.select(
        "sample_hash", "k", F.col("timestamp").alias("analyzed_at"),
        F.expr("CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END").alias("preprocessing_version"),
        F.expr(
            "CASE k % 6 WHEN 1 THEN 'classified' WHEN 3 THEN 'failed' ELSE 'pending' END"
        ).alias("classification_status"),
    )


def run_id() -> str:
    """A new name for the output of one streaming run."""
    return uuid.uuid4().hex


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: one per labelled document."""
    return (
        table(spark, sf_dir, "labels")
        .withColumn("sev", F.expr(rules.REPLY_SEVERITY))
        .withColumn("body", F.expr(rules.REPLY_BODY))
        .select(
            F.sha2(F.concat(F.lit("reply-"), F.col("doc_id").cast("string")), 256).alias("sample_hash"),
            F.expr("'target-' || CAST(doc_id % 10 AS STRING)").alias("target_id"),
            F.lit("model-a").alias("model"),
            F.expr(rules.REPLY_TEXT).alias("text"),
            (F.col("doc_id") % 900).alias("input_tokens"),
            (F.col("doc_id") % 70).alias("output_tokens"),
            _clock("doc_id").cast("timestamp").alias("received_at"),
        )
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = parse_replies(replies(spark, sf_dir), classified_at=F.col("received_at"))
    return rows


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("level"),
        F.concat("event_type", F.lit(" "), "props").alias("message"),
    )
