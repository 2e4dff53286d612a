"""Every operator as a query over the driver's tables, with its check in SQL.

Texts, arrays and times leave a query as plain strings and numbers, so that two
engines can be compared by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logprism.operators import alerts, classify, fields, formats, lines, listing, prompts, sampling, signals, stats, store
from logprism.plans import backfill as backfills, cycle as cycles
from logprism.plans.line_profile import profile_lines
from logprism.plans.profile import profile, profile_metrics
from logprism.sources import files, targets
from logprism.sources.shared import shared_folder
from logprism.streaming import follow as follows, ingest as streams
from logprism.testbed import logfiles, oracles as o, tables as t
from logprism.testbed.expected import SIGNALS
from logprism.testbed.oracles import sql, stamp, trimmed

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, check: str | None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        CATALOG[name] = Entry(run, check)
        return run

    return register


def time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(column: str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


# ---- targets

_PRESENT = {
    name: f"nullif({trimmed(name)}, '')"
    for name in ("target_id", "conn_host", "conn_user", "username", "password", "private_key",
                 "private_key_path", "cred_password", "cred_private_key_path")
}
_TOP_HOST = f"nullif({trimmed('coalesce(host, hostname, ip)')}, '')"
_METHOD = f"""lower({trimmed('''coalesce(auth_method, CASE WHEN coalesce(password, cred_password) IS NOT NULL THEN 'password'
 WHEN coalesce(private_key, private_key_path, cred_private_key_path) IS NOT NULL THEN 'private_key' END)''')})"""
_AUTH = f"""SELECT *, CASE WHEN method IS NULL THEN 'none'
 WHEN method = 'password' AND coalesce({_PRESENT['password']}, {_PRESENT['cred_password']}) IS NOT NULL THEN 'password'
 WHEN method IN ('private_key', 'key') AND {_PRESENT['private_key']} IS NOT NULL THEN 'private_key_inline'
 WHEN method IN ('private_key', 'key') AND coalesce({_PRESENT['private_key_path']}, {_PRESENT['cred_private_key_path']}) IS NOT NULL
  THEN 'private_key_path' END AS auth_kind FROM (SELECT *, {_METHOD} AS method FROM targets)"""
_AUTH_ERROR = f"""CASE WHEN auth_kind IS NOT NULL THEN NULL WHEN method = 'password' THEN '{targets.NO_PASSWORD}'
 WHEN method IN ('private_key', 'key') THEN '{targets.NO_KEY}' ELSE 'unsupported auth_method `' || method || '`' END"""
_PATHS = f"""list_filter(list_transform(string_split(coalesce(log_paths, conn_paths), '|'), lambda p: {trimmed('p')}), lambda p: p <> '')"""


@query("targets_active", sql("SELECT document_id, status FROM targets WHERE status = 'active'"))
def _(spark, d):
    return targets.active_targets(t.raw_targets(spark, d)).select("document_id", "status")


@query("targets_validate", sql(f"""SELECT document_id, tid AS target_id, hst AS host, prt AS port, usr AS username, auth_kind,
 coalesce(array_to_string(paths, ','), '') AS log_paths,
 CASE WHEN port > 65535 OR len(list_filter([host, hostname, ip], lambda x: x IS NOT NULL)) > 1 THEN '{targets.UNREADABLE}' ELSE array_to_string(list_filter([
  CASE WHEN tid IS NULL THEN '{targets.NO_TARGET}' END,
  CASE WHEN lower(st) <> 'active' THEN 'target status is `' || st || '` instead of `active`' END,
  CASE WHEN hst IS NULL THEN '{targets.NO_HOST}' END, CASE WHEN usr IS NULL THEN '{targets.NO_USER}' END,
  CASE WHEN coalesce(len(paths), 0) = 0 THEN '{targets.NO_PATHS}' END, {_AUTH_ERROR},
  CASE WHEN contains(tid, '$') OR starts_with(tid, 'system.')
   THEN 'target_id `' || tid || '` is not a valid MongoDB collection name' END], lambda r: r IS NOT NULL), '; ') END AS reasons
 FROM (SELECT *, {_PRESENT['target_id']} AS tid, coalesce({trimmed('status')}, '') AS st,
  coalesce({_TOP_HOST}, {_PRESENT['conn_host']}) AS hst, CAST(coalesce(port, conn_port, 22) AS INTEGER) AS prt,
  coalesce({_PRESENT['username']}, {_PRESENT['conn_user']}) AS usr, {_PATHS} AS paths FROM ({_AUTH}))"""))
def _(spark, d):
    checked = targets.check_targets(t.raw_targets(spark, d))
    return checked.select("document_id", "target_id", "host", "port", "username", "auth_kind",
                          joined("log_paths").alias("log_paths"), joined("reasons", "; ").alias("reasons"))


@query("targets_auth_kind", sql(f"""SELECT document_id, auth_kind, {_AUTH_ERROR} AS auth_error,
 CASE WHEN coalesce(private_key, '') <> '' THEN 'key-inline'
  WHEN coalesce(private_key_path, '') <> '' OR coalesce(cred_private_key_path, '') <> '' THEN 'key-file'
  WHEN coalesce(password, '') <> '' OR coalesce(cred_password, '') <> '' THEN 'password' ELSE 'agent' END AS auth_label
 FROM ({_AUTH})"""))
def _(spark, d):
    raw = targets.with_auth(t.raw_targets(spark, d))
    return raw.select("document_id", "auth_kind", "auth_error", targets.auth_label().alias("auth_label"))


@query("targets_list", sql("SELECT document_id, target_id FROM targets ORDER BY target_id, document_id"))
def _(spark, d):
    return targets.list_targets(t.raw_targets(spark, d)).select("document_id", "target_id")


@query("targets_search", sql("""SELECT document_id, target_id FROM targets WHERE status = 'active' AND
 (contains(lower(target_id), 'src1') OR contains(lower(coalesce(nullif(host, ''), nullif(hostname, ''), '')), 'src1'))"""))
def _(spark, d):
    return targets.search_targets(t.raw_targets(spark, d), "SRC1", "active").select("document_id", "target_id")


@query("dash_target_counts", sql("""SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
 count(*) - count(*) FILTER (status = 'active') AS inactive FROM targets"""))
def _(spark, d):
    return targets.target_counts(t.raw_targets(spark, d))


# ---- files and sampling

@query("files_discover", sql("SELECT * FROM found_files"))
def _(spark, d):
    return files.discover_files(t.file_targets(spark, d), t.inventory(spark, d))


@query("dir_outcomes", sql("""SELECT target_id, host, '__target__' AS source_file, 'error' AS processing_status,
 'connection refused' AS error_details FROM (SELECT DISTINCT target_id, host, k FROM file_targets) WHERE k % 19 = 7
 UNION ALL SELECT target_id, host, directory, CASE WHEN directory = '/data/absent' THEN 'missing_directory'
  WHEN directory = '/data/de' AND k % 7 = 1 THEN 'error' ELSE 'no_files_found' END,
 CASE WHEN directory = '/data/absent' THEN 'remote directory does not exist'
  WHEN directory = '/data/de' AND k % 7 = 1 THEN 'permission denied' ELSE 'no matching files found' END
 FROM file_targets ft WHERE k % 19 <> 7 AND (directory = '/data/absent' OR (directory = '/data/de' AND k % 7 = 1)
  OR NOT EXISTS (SELECT 1 FROM found_files f WHERE f.target_id = ft.target_id AND f.directory = ft.directory))"""))
def _(spark, d):
    asked = t.file_targets(spark, d)
    found = files.discover_files(asked, t.inventory(spark, d))
    rows = sampling.directory_outcomes(asked, t.directories(spark, d), found)
    return rows.select("target_id", "host", "source_file", "processing_status", "error_details")


def _scan(spark, d) -> DataFrame:
    """Lines of all files, read once in Python tasks and kept in the shared folder; what follows is SQL functions only."""
    found, path = files.scan_lines(spark, logfiles.write_log_files(spark, d)), shared_folder(spark, f"lines-{t.run_id()}")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


@query("file_line_count", sql("""SELECT target_id, path, max(line_rows) AS line_rows,
 max(line_rows) - CASE WHEN sum(strlen(value) + 1) - max(file_size) = 1 THEN 1 ELSE 0 END AS line_count,
 max(file_size) AS file_size FROM numbered GROUP BY target_id, path"""))
def _(spark, d):
    return files.file_stats(_scan(spark, d)).select("target_id", "path", "line_rows", "line_count", "file_size")


@query("file_inventory", sql("SELECT target_id, path, strlen(text)::BIGINT AS size FROM file_texts"))
def _(spark, d):
    return files.file_inventory(spark, logfiles.write_log_files(spark, d))


@query("lines_scan", sql("SELECT target_id, path, line_no, value FROM numbered"))
def _(spark, d):
    return files.number_lines(_scan(spark, d)).select("target_id", "path", "line_no", "value")


@query("lines_explode", sql("SELECT sample_hash, n AS line_no, line FROM lines"))
def _(spark, d):
    return lines.lines_explode(t.samples(spark, d))


_HEAD = "string_agg(raw, '' ORDER BY line_no) FILTER (line_no <= {n})"
_TAIL = "string_agg(raw, '' ORDER BY line_no) FILTER (line_no > line_rows - {n})"


@query("sample_head", sql(f"SELECT target_id, path, {_HEAD.format(n=20)} AS sample_content FROM broken GROUP BY target_id, path"))
def _(spark, d):
    return sampling.sample_lines(_scan(spark, d), "first", 20).select("target_id", "path", "sample_content")


@query("sample_tail", sql(f"SELECT target_id, path, {_TAIL.format(n=20)} AS sample_content FROM broken GROUP BY target_id, path"))
def _(spark, d):
    return sampling.sample_lines(_scan(spark, d), "last", 20).select("target_id", "path", "sample_content")


@query("sample_both", sql("SELECT target_id, path, sample_content, file_size FROM both_ends"))
def _(spark, d):
    rows = sampling.sample_lines(_scan(spark, d), "both")
    return rows.select("target_id", "path", "sample_content", "file_size")


@query("sample_status", sql(f"""SELECT f.target_id, host, source_file, coalesce(content, '') AS sample_content,
 CASE WHEN error IS NOT NULL THEN 'error' WHEN size = 0 OR {trimmed("coalesce(content, '')")} = '' THEN 'empty' ELSE 'stored' END AS processing_status,
 error AS error_details, coalesce(line_count, CASE WHEN error IS NULL THEN 0 END) AS line_count, size AS file_size_bytes FROM
 (SELECT f.*, CASE WHEN error IS NULL THEN s.content END AS content, line_count FROM
 (SELECT source AS target_id, 'store-' || lang AS host, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE strlen(text) END AS size,
  {t.rules.DOCUMENT_FILE} || CASE WHEN doc_id % 23 = 0 THEN '.none' WHEN doc_id % 29 = 0 THEN '.gone' ELSE '' END AS source_file,
  CASE WHEN doc_id % 31 = 0 THEN 'stream closed' WHEN doc_id % 23 <> 0 AND doc_id % 29 = 0 AND text <> '' THEN 'log file could not be read' END AS error,
  CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 50 END AS n FROM documents) f LEFT JOIN
 (SELECT target_id, path, {_TAIL.format(n="n")} AS content, max(line_rows) - count(*) FILTER (NOT ends_with(raw, chr(10))) AS line_count
  FROM (SELECT b.*, CASE WHEN coalesce(d.doc_id, 1) % 5 = 0 THEN 3 ELSE 50 END AS n FROM broken b
   LEFT JOIN documents d ON d.source = b.target_id AND b.path = {t.rules.DOCUMENT_FILE}) GROUP BY target_id, path) s
 ON s.path = source_file AND s.target_id = f.target_id) f"""))
def _(spark, d):
    drafts = sampling.sample_files(t.files(spark, d), _scan(spark, d), "last")
    return drafts.select("target_id", "host", "source_file", "sample_content", "processing_status", "error_details",
                         "line_count", "file_size_bytes")


@query("files_unreadable", f"""SELECT source AS target_id, {t.rules.DOCUMENT_FILE} AS source_file,
 CASE WHEN doc_id % 23 = 0 THEN 'empty' WHEN doc_id % 29 = 0 THEN 'error' ELSE 'stored' END AS processing_status,
 CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 = 0 THEN 'log file could not be read' END AS error_details,
 CASE WHEN doc_id % 23 = 0 THEN 0 ELSE strlen(text) END::BIGINT AS file_size_bytes,
 CASE WHEN doc_id % 23 = 0 THEN 0 WHEN doc_id % 29 <> 0 THEN length(text) - length(replace(text, chr(10), '')) END::BIGINT AS line_count
 FROM documents WHERE text <> ''""")
def _(spark, d):
    """Some files are empty, others vanish between listing and reading."""
    named = t.table(spark, d, "documents").where("text <> ''").withColumn("path", F.expr(t.rules.DOCUMENT_FILE)).withColumnRenamed("source", "target_id")
    root = logfiles.write_files(spark, named.withColumn("text", F.when(F.col("doc_id") % 23 == 0, F.lit("")).otherwise(F.col("text"))))
    listed = files.list_tree(spark, root).where("kind = 'file'").withColumn("host", F.lit("h"))
    logfiles.remove_files(named.where("doc_id % 23 <> 0 AND doc_id % 29 = 0"), root)
    drafts = sampling.sample_files(listed.drop("kind", "error"), files.read_lines(listed, root), "both")
    return drafts.select("target_id", "source_file", "processing_status", "error_details", "file_size_bytes", "line_count")


@query("collection_cycle", sql("""SELECT target_id, path AS source_file, sample_hash, processing_status, error_details, line_count, h.log_type, hint_worth AS worth_classifying,
 CASE WHEN row_number() OVER (ORDER BY sample_hash) > 25 THEN 'capped' WHEN signal_score < 0.05 THEN 'below_threshold' ELSE 'classify' END AS decision
 FROM cycle_samples JOIN hints h USING (sample_hash) JOIN scan USING (sample_hash)""", "cycle_samples"))
def _(spark, d):
    folder = shared_folder(spark, f"cycle-{t.run_id()}")
    kept, root = streams.SampleStore(spark, folder, 1), logfiles.write_log_files(spark, d)
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp")
    for name in ("first", "second"):  # the second run finds nothing new
        cycles.run_cycle(kept, t.cycle_targets(spark, d), root, cycle=name, timestamp=moment)
    decided = kept.decisions(max_per_cycle=25, cycle=F.col("timestamp"))
    metadata = kept.read("metadata").select(
        "sample_hash", "format.log_type", "ingestion_hints.worth_classifying"
    )
    rows = kept.read("samples").join(metadata, "sample_hash").join(decided, "sample_hash")
    return rows.select("target_id", "source_file", "sample_hash", "processing_status", "error_details", "line_count",
                       "log_type", "worth_classifying", "decision")


@query("log_tail", sql(f"""SELECT event_id, {trimmed("line")} AS line FROM
 (SELECT event_id, 'x' || line AS line FROM log_lines ORDER BY event_id DESC LIMIT 200)""").replace(
    f"{trimmed('line')} AS line", f"substr(rtrim(line, {o.WS}), 2) AS line"))
def _(spark, d):
    rows = t.log_lines(spark, d).select("event_id", "line")
    return listing.log_tail(rows, ["event_id"])


@query("log_line_class", sql("""SELECT event_id, line, CASE WHEN contains(lower(line), 'error') OR contains(lower(line), 'err ') THEN 'error'
 WHEN contains(lower(line), 'warn') THEN 'warn' WHEN contains(lower(line), 'debug') THEN 'debug' ELSE 'info' END AS class
 FROM log_lines WHERE contains(lower(line), 'tool')"""))
def _(spark, d):
    return listing.filter_lines(t.log_lines(spark, d).select("event_id", "line"), "TOOL")


# ---- identity and store

@query("sample_hash", sql("SELECT target_id, source_file, processing_status, sample_hash FROM samples"))
def _(spark, d):
    return t.samples(spark, d).select("target_id", "source_file", "processing_status", "sample_hash")


@query("sample_targets", sql("SELECT DISTINCT target_id FROM samples ORDER BY target_id"))
def _(spark, d):
    return listing.sample_targets(t.samples(spark, d))


def _stored(spark, d):
    """Log samples of every fifth user, as an earlier state of the store."""
    return t.log_samples(spark, d).where(t.user_of_file() % 5 == 0)


@query("sample_dedup", sql(f"""SELECT sample_hash, {stamp('"timestamp"')} AS first_seen, delivery_id FROM deliveries
 WHERE delivery_id = 0 AND k % 5 <> 0"""))
def _(spark, d):
    fresh = store.dedup_samples(t.deliveries(spark, d), _stored(spark, d))
    return fresh.select("sample_hash", time_text("timestamp").alias("first_seen"), "delivery_id")


@query("store_outcomes", sql("""SELECT sample_hash, delivery_id,
 CASE WHEN delivery_id = 0 AND k % 5 <> 0 THEN 'inserted' ELSE 'duplicate' END AS outcome FROM deliveries"""))
def _(spark, d):
    outcomes = store.store_outcomes(t.deliveries(spark, d), _stored(spark, d))
    return outcomes.select("sample_hash", "delivery_id", "outcome")


def _keys(spark, d) -> DataFrame:
    """Keys and states of the metadata, without the profile itself."""
    columns = ["sample_hash", "k", "analyzed_at", "preprocessing_version", "classification_status"]
    return t.metadata_keys(spark, d).select(*columns)


@query("metadata_upsert", sql(f"""SELECT sample_hash, preprocessing_version, {stamp('analyzed_at')} AS analyzed_at FROM metadata_keys WHERE k % 2 = 1
 UNION ALL SELECT sample_hash, '2', {stamp('"timestamp" + INTERVAL 2 DAY')} FROM log_samples WHERE k % 2 = 0"""))
def _(spark, d):
    again = t.log_samples(spark, d).where(t.user_of_file() % 2 == 0)
    incoming = again.select(
        "sample_hash", F.explode(F.expr("array(1, 2)")).alias("v"), "timestamp"
    ).select(
        "sample_hash", F.col("v").cast("string").alias("preprocessing_version"),
        (F.col("timestamp") + F.expr("make_dt_interval(v)")).alias("analyzed_at"),
    )
    columns = ["sample_hash", "preprocessing_version", "analyzed_at"]
    merged = store.upsert(_keys(spark, d).select(*columns), incoming, [F.desc("analyzed_at")])
    return merged.withColumn("analyzed_at", time_text("analyzed_at"))


@query("status_update", sql("""SELECT sample_hash, CASE WHEN k % 5 = 0 THEN 'classified' WHEN k % 5 = 1 THEN 'failed'
 ELSE classification_status END AS classification_status FROM metadata_keys"""))
def _(spark, d):
    user = t.user_of_file()
    logs = t.log_samples(spark, d)
    updates = classify.status_updates(logs.where(user % 5 == 0), logs.where(user % 5 == 1))
    return store.update_status(_keys(spark, d), updates).select("sample_hash", "classification_status")


@query("metadata_purge", sql("SELECT sample_hash, preprocessing_version FROM metadata_keys WHERE preprocessing_version = '1'"))
def _(spark, d):
    kept, _count = store.purge_stale(_keys(spark, d), "1")
    return kept.select("sample_hash", "preprocessing_version")


@query("metadata_purge_count", sql("SELECT count(*) AS deleted FROM metadata_keys WHERE preprocessing_version IS DISTINCT FROM '1'"))
def _(spark, d):
    return store.purge_stale(_keys(spark, d), "1")[1]


@query("store_merge", sql("""SELECT sample_hash, '1' AS preprocessing_version, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'pending' END AS classification_status
 FROM log_samples WHERE k % 2 = 1"""))
def _(spark, d):
    """Half of the profiles in a store are replaced by stale ones, statuses change, parts are joined, stale rows go."""
    kept, logs, user = streams.SampleStore(spark, shared_folder(spark, f"merge-{t.run_id()}"), 1), t.log_samples(spark, d), t.user_of_file()
    kept.add_batch(logs, "logs", 0)
    stale = kept.read("metadata").join(logs.where(user % 2 == 0).select("sample_hash"), "sample_hash", "left_semi")
    kept.merge_metadata(stale.withColumn("preprocessing_version", F.lit("0")), [F.col("analyzed_at")])
    kept.update_status(logs.where(user % 3 == 0).select("sample_hash", F.lit("failed").alias("new_status")))
    kept.compact()
    kept.purge("1")
    return kept.read("metadata").select("sample_hash", "preprocessing_version", "classification_status")


@query("samples_unprocessed", sql(f"""SELECT sample_hash, target_id, {stamp('"timestamp"')} AS seen FROM samples
 WHERE sample_hash NOT IN (SELECT sample_hash FROM metadata_keys) ORDER BY "timestamp" DESC, sample_hash LIMIT 300"""))
def _(spark, d):
    rows = store.unprocessed_samples(t.samples(spark, d), _keys(spark, d), 300)
    return rows.select("sample_hash", "target_id", time_text("timestamp").alias("seen"))


@query("backfill_summary", sql("""SELECT count(*) AS attempted, count(*) AS written, CAST(0 AS BIGINT) AS failed, count(*) FILTER (hint_worth) AS agentic
 FROM hints WHERE sample_hash NOT IN (SELECT sample_hash FROM metadata_keys WHERE preprocessing_version = '1')"""))
def _(spark, d):
    path = shared_folder(spark, f"backfill-{t.run_id()}")
    done = backfills.run_backfill(t.samples(spark, d), t.metadata_keys(spark, d), path, reprocess_stale=True)
    row = (done.attempted, done.written, done.failed, done.agentic)
    return spark.createDataFrame([row], "attempted long, written long, failed long, agentic long")


# ---- profile

@query("format_scores", sql("SELECT * FROM scores"))
def _(spark, d):
    return formats.format_scores(t.samples(spark, d))


@query("format_detect", sql("SELECT sample_hash, log_type, multiline FROM format_rows"))
def _(spark, d):
    return formats.format_detect(t.samples(spark, d)).select("sample_hash", "log_type", "multiline")


@query("format_field_roles", sql("SELECT sample_hash, timestamp_field, level_field, message_field FROM format_rows"))
def _(spark, d):
    rows = formats.format_detect(t.samples(spark, d))
    return rows.select("sample_hash", "timestamp_field", "level_field", "message_field")


@query("line_stats", sql("SELECT *, CAST(NULL AS BIGINT) AS time_span_secs FROM stats"))
def _(spark, d):
    return stats.line_stats(t.samples(spark, d))


def _register_levels(log_type: str, name: str, expression: str) -> None:
    @query(name, sql(f"SELECT sample_hash, line_no, {expression} AS level FROM stat_texts"))
    def _(spark, d):
        return stats.line_levels(t.samples(spark, d), log_type)


_register_levels("json", "levels_json", o.json_level("line"))
_register_levels("logfmt", "levels_logfmt", o.logfmt_level("line"))
_register_levels("syslog", "levels_syslog", o.syslog_level("line"))
_register_levels("plain_text", "levels_plain", o.plain_level("line"))


@query("level_distribution", sql("SELECT sample_hash, level, count(*) AS n FROM levels WHERE level IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    return stats.level_distribution(t.samples(spark, d))


@query("signal_pattern_hits", sql(" UNION ALL ".join(
    f"SELECT '{label}' AS pattern, count(*) FILTER (s{i}) AS hit_lines FROM flags" for i, (label, _, _) in enumerate(SIGNALS))))
def _(spark, d):
    return signals.signal_pattern_hits(t.samples(spark, d))


@query("signal_scan", sql("SELECT * FROM scan"))
def _(spark, d):
    return signals.signal_scan(t.samples(spark, d))


@query("signal_patterns", sql("SELECT * FROM pattern_rows"))
def _(spark, d):
    return signals.signal_patterns(t.samples(spark, d))


@query("signal_frameworks", sql("SELECT * FROM framework_rows"))
def _(spark, d):
    return signals.signal_frameworks(t.samples(spark, d))


@query("json_fields", sql("SELECT sample_hash, field, type, count(*) AS n FROM json_observed GROUP BY ALL"))
def _(spark, d):
    return fields.typed_fields(t.samples(spark, d), "json")


@query("logfmt_fields", sql("SELECT sample_hash, field, type, count(*) AS n FROM logfmt_observed GROUP BY ALL"))
def _(spark, d):
    return fields.typed_fields(t.samples(spark, d), "logfmt")


@query("field_schema", sql("SELECT * FROM schema_rows"))
def _(spark, d):
    return fields.field_schema(t.samples(spark, d))


@query("schema_coverage", sql("SELECT sample_hash, sample_coverage, fields FROM coverage"))
def _(spark, d):
    return fields.schema_coverage(t.samples(spark, d))


@query("ingestion_hints", sql("""SELECT sample_hash, prompt_template, suggested_chunk_size, hint_worth AS worth_classifying,
 skip_reason, priority FROM hints"""))
def _(spark, d):
    return profile(t.samples(spark, d)).select("sample_hash", "ingestion_hints.*")


_PROFILE_SQL = sql("""SELECT s.sample_hash, s.target_id, '1' AS preprocessing_version, f.log_type, f.timestamp_field, f.level_field,
 f.message_field, f.multiline, x.total_lines, x.non_empty_lines, x.empty_line_ratio, x.avg_line_length, x.unique_line_ratio,
 coalesce(l.levels, '') AS levels, c.signal_score, c.worth_classifying, c.agentic_line_count,
 coalesce(p.patterns, '') AS patterns, coalesce(w.frameworks, '') AS frameworks, coalesce(q.fields, '') AS fields, v.sample_coverage,
 h.prompt_template, h.suggested_chunk_size, h.hint_worth, h.skip_reason, h.priority, 'pending' AS classification_status
 FROM samples s JOIN format_rows f USING (sample_hash) JOIN stats x USING (sample_hash) JOIN scan c USING (sample_hash)
 JOIN hints h USING (sample_hash) LEFT JOIN coverage v USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(level || '=' || CAST(n AS STRING), ',' ORDER BY level) AS levels FROM
  (SELECT sample_hash, level, count(*) AS n FROM levels WHERE level IS NOT NULL GROUP BY ALL) GROUP BY ALL) l USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(pattern, ',' ORDER BY position) AS patterns FROM pattern_rows GROUP BY ALL) p USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(framework, ',' ORDER BY framework) AS frameworks FROM framework_rows GROUP BY ALL) w USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(field || ':' || inferred_type, ',' ORDER BY position) AS fields FROM schema_rows GROUP BY ALL) q USING (sample_hash)""")


def profile_row(metadata: DataFrame) -> DataFrame:
    """Metadata with its arrays and maps as text."""
    levels = F.transform(
        F.array_sort(F.map_entries("stats.level_distribution")),
        lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")),
    )
    names = F.transform("schema.fields", lambda f: F.concat(f["name"], F.lit(":"), f.inferred_type))
    hints = [F.col(f"ingestion_hints.{c}") for c in ("prompt_template", "suggested_chunk_size", "skip_reason", "priority")]
    return metadata.select(
        "sample_hash", "target_id", "preprocessing_version", "format.log_type", "format.timestamp_field",
        "format.level_field", "format.message_field", "format.multiline", "stats.total_lines", "stats.non_empty_lines",
        "stats.empty_line_ratio", "stats.avg_line_length", "stats.unique_line_ratio",
        F.array_join(levels, ",").alias("levels"), "agentic_scan.signal_score", "agentic_scan.worth_classifying",
        "agentic_scan.agentic_line_count", joined("agentic_scan.matched_patterns").alias("patterns"),
        joined("agentic_scan.detected_frameworks").alias("frameworks"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("fields"), "schema.sample_coverage", *hints,
        F.col("ingestion_hints.worth_classifying").alias("hint_worth"), "classification_status",
    )


@query("profile", _PROFILE_SQL)
def _(spark, d):
    return profile_row(profile(t.samples(spark, d)))


@query("profile_lines", _PROFILE_SQL)
def _(spark, d):
    """The same profile, of texts that are a row per line."""
    rows = t.samples(spark, d)
    return profile_row(profile_lines(rows, lines.lines_explode(rows)))


@query("profile_metrics", sql("""SELECT target_id, count(*) AS processed, count(*) FILTER (hint_worth) AS agentic,
 count(*) FILTER (NOT hint_worth) AS not_agentic FROM samples JOIN hints USING (sample_hash) GROUP BY target_id"""))
def _(spark, d):
    return profile_metrics(profile(t.samples(spark, d)))


# ---- classification and alerts

@query("classify_pending", sql("""SELECT sample_hash, m.target_id, signal_score, source_file, sample_content FROM
 (SELECT * FROM metadata WHERE hint_worth AND signal_score >= 0.05 AND classification_status = 'pending'
  ORDER BY signal_score DESC, sample_hash LIMIT 10) m JOIN log_samples USING (sample_hash)""", "log_samples"))
def _(spark, d):
    rows = classify.pending_classifications(t.metadata(spark, d), t.log_samples(spark, d), limit=10)
    return rows.select("sample_hash", "target_id", "agentic_scan.signal_score", "source_file", "sample_content")


@query("classify_gate", sql("""SELECT sample_hash, CASE WHEN arrival > 10 THEN 'capped' WHEN signal_score < 0.05 THEN 'below_threshold'
 WHEN classification_status = 'classified' THEN 'already_classified' ELSE 'classify' END AS decision FROM
 (SELECT *, row_number() OVER (ORDER BY analyzed_at, sample_hash) AS arrival FROM metadata)""", "log_samples"))
def _(spark, d):
    batch = t.metadata(spark, d).withColumnRenamed("analyzed_at", "timestamp")
    return classify.classify_gate(batch, max_per_cycle=10).select("sample_hash", "decision")


_TRUNCATED = """CASE WHEN n <= chunk THEN sample_content ELSE
 array_to_string(list_slice(ls, 1, chunk // 2), chr(10)) || chr(10) || '[... truncated ...]' || chr(10) ||
 array_to_string(list_slice(ls, n - chunk // 2 + 1, n), chr(10)) END"""
_TRUNCATE_FROM = """(SELECT s.*, h.suggested_chunk_size AS chunk, h.prompt_template, coalesce(l.ls, []) AS ls, coalesce(len(l.ls), 0) AS n
 FROM samples s JOIN hints h USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, list(line ORDER BY n) AS ls FROM lines GROUP BY ALL) l USING (sample_hash))"""


@query("prompt_truncate", sql(f"SELECT sample_hash, {_TRUNCATED} AS content FROM {_TRUNCATE_FROM}"))
def _(spark, d):
    rows = profile(t.samples(spark, d), keep=("sample_content",))
    return prompts.truncate_samples(rows).select("sample_hash", "content")


_SYSTEM = ("CASE prompt_template " + " ".join(f"WHEN '{k}' THEN {o.quote(v)}" for k, v in prompts.ROLES.items())
           + f" ELSE {o.quote(prompts.GENERIC_ROLE)} END || chr(10) || chr(10) || {o.quote(prompts.REPLY_SCHEMA)}")


@query("prompt_build", sql(f"""SELECT sample_hash, target_id, {_SYSTEM} AS system,
 concat_ws(chr(10) || chr(10), '## Log sample' || chr(10) || chr(10) || 'Target: ' || target_id || chr(10) || 'Host: ' || host || chr(10) || 'File: ' || source_file,
 '## Preprocessor signals' || chr(10) || chr(10) || 'Matched patterns: ' || patterns || chr(10) || 'Signal score: ' || printf('%.4f', signal_score),
 'Detected frameworks: ' || frameworks, '## Content' || chr(10) || chr(10) || {_TRUNCATED}, {o.quote(prompts.INSTRUCTION)}) AS "user"
 FROM {_TRUNCATE_FROM} JOIN scan USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(pattern, ', ' ORDER BY position) AS patterns FROM pattern_rows GROUP BY ALL) USING (sample_hash)
 LEFT JOIN (SELECT sample_hash, string_agg(framework, ', ' ORDER BY framework) AS frameworks FROM framework_rows GROUP BY ALL) USING (sample_hash)"""))
def _(spark, d):
    profiled = profile(t.samples(spark, d), keep=("host", "source_file", "sample_content"))
    return prompts.build_prompts(profiled)


@query("response_parse", sql(f"""SELECT sample_hash, target_id, {stamp('classified_at')} AS classified_at, severity, summary, confidence,
 array_to_string(categories, ',') AS categories, array_to_string(recommendations, ',') AS recommendations,
 array_to_string(list_transform(key_findings, lambda f: f.pattern || '/' || CAST(f.count AS STRING) || '/' || f.severity || '/' || f.example), ';') AS findings
 FROM classifications"""))
def _(spark, d):
    finding = F.transform(
        "key_findings",
        lambda f: F.concat_ws("/", f.pattern, f["count"].cast("string"), f.severity, f.example),
    )
    return t.classifications(spark, d).select(
        "sample_hash", "target_id", time_text("classified_at").alias("classified_at"), "severity", "summary", "confidence",
        joined("categories").alias("categories"), joined("recommendations").alias("recommendations"),
        F.array_join(finding, ";").alias("findings"),
    )


@query("response_failures", sql("SELECT sample_hash, 'model returned non-JSON' AS error FROM bare_replies WHERE NOT json_valid(j)"))
def _(spark, d):
    return classify.parse_replies(t.replies(spark, d))[1].select("sample_hash", "error")


@query("alerts", sql("SELECT sample_hash, severity, CASE severity WHEN 'critical' THEN 3 ELSE 2 END AS rank FROM classifications WHERE severity IN ('critical', 'warning')"))
def _(spark, d):
    chosen = alerts.select_alerts(t.classifications(spark, d), "warning")
    return chosen.select("sample_hash", "severity", classify.severity_rank(F.col("severity")).alias("rank"))


@query("alert_payload", sql("""SELECT sample_hash, 'classification.alert' AS event, severity, target_id, summary, confidence,
 'model-a' AS model, doc_id % 900 AS input_tokens, doc_id % 70 AS output_tokens, array_to_string(categories, ',') AS categories,
 array_to_string(recommendations, ',') AS recommendations, len(key_findings) AS findings, key_findings[1].pattern AS first_pattern
 FROM classifications WHERE severity = 'critical'"""))
def _(spark, d):
    rows = alerts.alert_payload(alerts.select_alerts(t.classifications(spark, d)))
    # The members of the JSON text, read back, so that they can be compared by value.
    event = F.from_json("payload", """event string, severity string, target_id string, summary string, confidence double,
        model string, input_tokens long, output_tokens long, categories array<string>, recommendations array<string>,
        key_findings array<struct<pattern:string>>""")
    return rows.select("sample_hash", event.alias("e")).select(
        "sample_hash", "e.event", "e.severity", "e.target_id", "e.summary", "e.confidence", "e.model", "e.input_tokens",
        "e.output_tokens", joined("e.categories").alias("categories"), joined("e.recommendations").alias("recommendations"),
        F.size("e.key_findings").cast("bigint").alias("findings"), F.get("e.key_findings", F.lit(0)).pattern.alias("first_pattern"),
    )


@query("alert_text", sql("""SELECT sample_hash, CASE severity WHEN 'critical' THEN '🚨' WHEN 'warning' THEN '⚠️' WHEN 'info' THEN 'ℹ️' ELSE '✅' END
 || ' logprism: ' || upper(severity) || ' finding on ' || target_id AS title,
 '*Target:* `' || target_id || '`' || chr(10) || '*Summary:* ' || summary
 || CASE WHEN len(key_findings) > 0 THEN chr(10) || '*Key findings:*' || chr(10) || array_to_string(list_transform(list_slice(key_findings, 1, 5),
   lambda f: '• *' || f.pattern || '* ×' || CAST(f.count AS STRING) || ' — _' || f.severity || '_'), chr(10)) ELSE '' END
 || CASE WHEN len(recommendations) > 0 THEN chr(10) || '*Recommendations:*' || chr(10) || array_to_string(list_transform(
   list_slice(recommendations, 1, 3), lambda r: '→ ' || r), chr(10)) ELSE '' END
 || chr(10) || '*Confidence:* ' || CAST(CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS STRING) || '%  |  *Model:* `model-a`' AS body FROM classifications"""))
def _(spark, d):
    return alerts.alert_text(t.classifications(spark, d))


# ---- listings

_SAMPLE_COLUMNS = f'sample_hash, target_id, source_file, {stamp(chr(34) + "timestamp" + chr(34))} AS seen, sample_content'


@query("samples_page", sql(f'SELECT {_SAMPLE_COLUMNS} FROM samples ORDER BY "timestamp" DESC, sample_hash LIMIT 50 OFFSET 100'))
def _(spark, d):
    rows = listing.samples_page(t.samples(spark, d), page=3)
    return rows.select("sample_hash", "target_id", "source_file", time_text("timestamp").alias("seen"), "sample_content")


@query("samples_page_total", sql("SELECT count(*) AS total FROM samples WHERE target_id = 'web'"))
def _(spark, d):
    return listing.page_total(t.samples(spark, d), "web")


@query("samples_size_label", sql("""SELECT sample_hash, CASE WHEN b IS NULL THEN '—' WHEN b < 1024 THEN CAST(b AS STRING) || 'B'
 WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024.0 * 10 + 0.5) / 10) || 'KB'
 ELSE printf('%.1f', floor(b / 1048576.0 * 10 + 0.5) / 10) || 'MB' END AS size FROM
 (SELECT sample_hash, CASE processing_status WHEN 'empty' THEN NULL ELSE file_size_bytes END AS b FROM samples)"""))
def _(spark, d):
    known = F.when(F.col("processing_status") != "empty", F.col("file_size_bytes"))
    return t.samples(spark, d).select("sample_hash", listing.size_label(known).alias("size"))


@query("classifications_page", sql(f"""SELECT sample_hash, severity, {stamp('classified_at')} AS classified_at FROM classifications
 WHERE target_id = 'target-3' ORDER BY classifications.classified_at DESC, sample_hash LIMIT 10 OFFSET 10"""))
def _(spark, d):
    rows = listing.classifications_page(t.classifications(spark, d), "target-3", limit=10, page=1)
    return rows.select("sample_hash", "severity", time_text("classified_at").alias("classified_at"))


@query("classification_by_hash", sql("SELECT sample_hash, severity, summary FROM classifications WHERE sample_hash = sha256('reply-0')"))
def _(spark, d):
    key = hashlib.sha256(b"reply-0").hexdigest()
    return listing.classification_by_hash(t.classifications(spark, d), key).select("sample_hash", "severity", "summary")


@query("classifications_by_severity", sql("""SELECT sample_hash, severity FROM
 (SELECT * FROM classifications ORDER BY classified_at DESC, sample_hash LIMIT 50) WHERE severity = 'warning'"""))
def _(spark, d):
    page = listing.classifications_page(t.classifications(spark, d))
    return listing.by_severity(page, "warning").select("sample_hash", "severity")


@query("dash_severity_counts", sql("""SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
 count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'normal') AS normal FROM classifications"""))
def _(spark, d):
    return listing.severity_counts(t.classifications(spark, d))


@query("dash_recent_criticals", sql("""SELECT sample_hash, target_id, summary FROM classifications WHERE severity = 'critical'
 ORDER BY classified_at DESC, sample_hash LIMIT 5"""))
def _(spark, d):
    return listing.recent_criticals(t.classifications(spark, d)).select("sample_hash", "target_id", "summary")


@query("tracking_search", f"""SELECT event_id AS id, {stamp('ts')} AS logged, event_type AS level, event_type || ' ' || props AS message FROM events
 WHERE event_type = 'error' AND regexp_matches(event_type || ' ' || props, '(?i)"K": [1-3]') ORDER BY ts DESC, id LIMIT 50 OFFSET 50""")
def _(spark, d):
    rows = listing.tracking_search(t.tracking(spark, d), '"K": [1-3]', "error", page=1)
    return rows.select("id", time_text("timestamp").alias("logged"), "level", "message")


# ---- streaming

FEED_FILES = 6


def _document_stream(spark, d) -> DataFrame:
    """Documents as a stream of several files of mixed age, one per cycle."""
    folder = shared_folder(spark, f"feed-{t.run_id()}")
    documents = t.table(spark, d, "documents")
    documents.repartitionByRange(FEED_FILES, F.xxhash64("doc_id")).write.parquet(folder)
    return t.feed(streams.read_deliveries(spark, folder, documents.schema, files_per_cycle=1))


@query("stream_dedup", sql("SELECT DISTINCT sample_hash, target_id, source_file FROM feed"))
def _(spark, d):
    folder = shared_folder(spark, f"dedup-{t.run_id()}")
    fresh = streams.drop_repeats(_document_stream(spark, d)).select("sample_hash", "target_id", "source_file")
    writer = fresh.writeStream.format("parquet").option("path", f"{folder}/rows")
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query("stream_profile", sql("""SELECT u.sample_hash, log_type, signal_score, hint_worth AS worth_classifying,
 CASE WHEN arrival > 10 THEN 'capped' WHEN signal_score < 0.05 THEN 'below_threshold' ELSE 'classify' END AS decision FROM
 (SELECT sample_hash, row_number() OVER (PARTITION BY date_trunc('minute', seen) ORDER BY seen, sample_hash) AS arrival FROM
  (SELECT sample_hash, min("timestamp") AS seen FROM feed GROUP BY sample_hash)) u
 JOIN scan USING (sample_hash) JOIN hints USING (sample_hash)""", "(SELECT DISTINCT sample_hash, sample_content FROM feed)"))
def _(spark, d):
    folder = shared_folder(spark, f"ingest-{t.run_id()}")
    kept = streams.SampleStore(spark, f"{folder}/store", 1)
    streams.ingest(_document_stream(spark, d), kept, f"{folder}/progress", stream="documents", once=True).awaitTermination()
    kept.compact()
    metadata = kept.read("metadata").select(
        "sample_hash", "format.log_type", "agentic_scan.signal_score", "ingestion_hints.worth_classifying"
    )
    decided = kept.decisions(max_per_cycle=10, cycle=F.date_trunc("minute", "timestamp"))
    return metadata.join(decided.select("sample_hash", "decision"), "sample_hash")


@query("stream_outcomes", sql("""SELECT DISTINCT sample_hash, CASE WHEN sample_hash < '8' THEN 'classified' WHEN sample_hash < 'c' THEN 'failed' ELSE 'pending' END
 AS classification_status FROM feed"""))
def _(spark, d):
    """Samples stream into a store; replies of a model for three quarters of them change their status there."""
    folder = shared_folder(spark, f"outcomes-{t.run_id()}")
    kept = streams.SampleStore(spark, f"{folder}/store", 1)
    streams.ingest(_document_stream(spark, d), kept, f"{folder}/progress", stream="documents", once=True).awaitTermination()
    reply = F.when(F.col("sample_hash") < "8", F.lit('{"severity": "info"}')).otherwise(F.lit("no idea"))
    asked = kept.read("samples").where("sample_hash < 'c'").select(
        "sample_hash", "target_id", F.lit("model-a").alias("model"), reply.alias("text"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    kept.update_status(classify.status_updates(*classify.parse_replies(asked)))
    return kept.read("metadata").select("sample_hash", "classification_status")


_WHOLE = "regexp_extract({}, '(?s)^.*\\n')"  # up to the last line break


@query("log_follow", f"""SELECT DISTINCT target_id, source_file, sample_content,
 CASE WHEN {trimmed("sample_content")} = '' THEN 'empty' ELSE 'stored' END AS processing_status FROM
 (SELECT target_id, source_file, CASE WHEN ends_with(part, chr(10))
   THEN array_to_string(l[greatest(len(l) - 3, 1):len(l) - 1], chr(10)) || chr(10) ELSE part END AS sample_content FROM
 (SELECT target_id, source_file, part, string_split(part, chr(10)) AS l FROM
 (SELECT target_id, source_file, unnest([a, substr(b, length(a) + 1), substr(text, length(b) + 1)]) AS part FROM
 (SELECT source AS target_id, {t.rules.DOCUMENT_FILE} AS source_file, text, {_WHOLE.format("left(text, length(text) // 2)")} AS a,
  {_WHOLE.format("text")} AS b FROM documents WHERE text <> '')) WHERE part <> ''))""")
def _(spark, d):
    """Files appear with half their text and grow after a cycle; each cycle is run by a follower of its own."""
    folder = shared_folder(spark, f"follow-{t.run_id()}")
    whole = t.table(spark, d, "documents").where("text <> ''").select(
        F.col("source").alias("target_id"), F.expr(t.rules.DOCUMENT_FILE).alias("path"), "text")
    hosts = whole.select("target_id", F.lit("h").alias("host"), F.lit(None).cast("long").alias("max_files"), F.array(F.lit("/srv")).alias("log_paths")).distinct()
    half = whole.withColumn("text", F.expr("left(text, CAST(char_length(text) DIV 2 AS INT))"))
    for files_now in (half, whole, None, None):  # the last cycle finds nothing
        if files_now is not None:
            logfiles.write_files(spark, files_now, f"{folder}/hosts")
        kept = streams.SampleStore(spark, f"{folder}/store", 1)
        follows.LogFollower(kept, f"{folder}/hosts", "logs", mode="last", n=3).cycle(hosts)
    return kept.read("samples").select("target_id", "source_file", "sample_content", "processing_status")
