"""The testbed tables and their analysis in ANSI SQL, for a second engine.

``sql(body)`` puts the common table expressions a query names in front of it.
"""

from __future__ import annotations

import re

from logprism.testbed import rules
from logprism.testbed.expected import (
    JSON_LEVEL_KEYS, LEVEL_KEYS, LEVEL_WORDS, LOGFMT_LEVEL_KEYS, MESSAGE_KEYS, SIGNALS, SYSLOG_LABELS, TIMESTAMP_KEYS, TYPES,
    WHITE_SPACE,
)

WS = "(" + " || ".join(f"chr({c})" for c in WHITE_SPACE) + ")"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


def trimmed(x: str) -> str:
    return f"trim({x}, {WS})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def label_of(word: str) -> str:
    cases = " ".join(f"WHEN {quote(w)} THEN {quote(label)}" for w, label in LEVEL_WORDS)
    return f"(CASE lower(trim({trimmed(word)}, '\"')) {cases} END)"


def json_level(line: str) -> str:
    def by_key(name: str) -> str:
        k = quote(f'"{name}"')
        rest = f"substr({line}, strpos({line}, {k}) + {len(name) + 2})"
        quoted = f"regexp_extract({rest}, '^\\s*:\\s*\"([^\"]*)', 1)"
        bare = f"regexp_extract({rest}, '^\\s*:\\s*([^,}} \"][^,}} ]*)', 1)"
        return f"CASE WHEN strpos({line}, {k}) > 0 THEN coalesce({label_of(quoted)}, {label_of(bare)}) END"

    return "coalesce(" + ", ".join(map(by_key, JSON_LEVEL_KEYS)) + ")"


def logfmt_level(line: str) -> str:
    keys = in_list(LOGFMT_LEVEL_KEYS)
    hits = (
        f"list_filter(regexp_split_to_array({trimmed(line)}, '\\s+'), "
        f"lambda t: contains(t, '=') AND lower(split_part(t, '=', 1)) IN {keys})"
    )
    return label_of(f"regexp_replace({hits}[1], '^[^=]*=', '')")


def plain_level(line: str) -> str:
    up = f"upper({line})"
    cases = []
    for word, label in LEVEL_WORDS:
        w = word.upper()
        cases.append(
            f"WHEN contains({up}, '[{w}]') OR contains({up}, '{w}:') OR contains({up}, ' {w} ') "
            f"OR starts_with({up}, '{w}') THEN '{label}'"
        )
    return "(CASE " + " ".join(cases) + " END)"


def syslog_level(line: str) -> str:
    p = f"try_cast(regexp_extract({line}, '^<(\\+?\\d+)>', 1) AS INTEGER)"
    by_number = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(SYSLOG_LABELS))
    return f"(CASE WHEN {p} <= 255 THEN CASE {p} % 8 {by_number} END ELSE {plain_level(line)} END)"


def hit(line: str, pattern: str) -> str:
    return f"regexp_matches({line}, {quote('(?i)' + pattern)})"


def target_columns() -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in rules.TARGET_FIELDS.items())


def _sample_select(source: str) -> str:
    return f"""SELECT *, length(sample_content) - length(replace(sample_content, chr(10), '')) AS line_count,
 strlen(sample_content) AS file_size_bytes,
 CASE WHEN {trimmed('sample_content')} = '' THEN 'empty' ELSE 'stored' END AS processing_status,
 sha256(target_id || chr(0) || source_file || chr(0) || sampling_mode || chr(0) || sample_content || chr(0) ||
   (CASE WHEN {trimmed('sample_content')} = '' THEN 'empty' ELSE 'stored' END) || chr(0)) AS sample_hash
 FROM ({source})"""


_FLAGS = ", ".join(f"{hit('line', pattern)} AS s{i}" for i, (_, _, pattern) in enumerate(SIGNALS))
_ANY = " OR ".join(f"s{i}" for i in range(len(SIGNALS)))
_TYPE_RANK = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"

CTES = {
    "log_lines": f"""SELECT user_id, event_id, ts, event_type, {rules.LINE} AS line FROM
 (SELECT *, {rules.LEVEL} AS lvl, {rules.MESSAGE} AS msg FROM events)""",
    "log_samples": _sample_select(
        """SELECT ts AS "timestamp", 'target-' || CAST(user_id % 10 AS STRING) AS target_id,
 '/var/log/app/u' || CAST(user_id AS STRING) || '.' || CAST(segment AS STRING) || '.log' AS source_file,
 CASE WHEN user_id % 29 = 0 THEN '' ELSE content END AS sample_content,
 'host-' || CAST(user_id % 7 AS STRING) AS host, 'both' AS sampling_mode, user_id AS k FROM
 (SELECT user_id, """
        + rules.SEGMENT
        + """ AS segment, string_agg(line, chr(10) ORDER BY event_id) AS content, max(ts) AS ts
  FROM log_lines GROUP BY ALL)"""
    ),
    "document_samples": _sample_select(
        f"""SELECT {rules.EPOCH} + doc_id * INTERVAL 1 SECOND AS "timestamp", source AS target_id,
 '/srv/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS source_file, text AS sample_content,
 'store-' || lang AS host, 'first' AS sampling_mode, CAST(NULL AS BIGINT) AS k FROM documents"""
    ),
    "page_samples": _sample_select(
        f"""SELECT {rules.EPOCH} + page_id * INTERVAL 1 SECOND AS "timestamp", 'web' AS target_id,
 url AS source_file, html AS sample_content, 'crawler' AS host, 'last' AS sampling_mode,
 CAST(NULL AS BIGINT) AS k FROM pages"""
    ),
    "samples": "SELECT * FROM log_samples UNION ALL SELECT * FROM document_samples UNION ALL SELECT * FROM page_samples",
    "feed": _sample_select(
        f"""SELECT {rules.EPOCH} + (doc_id + 30 * again) * INTERVAL 1 SECOND AS "timestamp", source AS target_id,
 '/feed/' || lang AS source_file, text AS sample_content, 'feeder' AS host, 'first' AS sampling_mode FROM
 (SELECT *, unnest(CASE WHEN doc_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS again FROM documents)"""
    ),
    "deliveries": """SELECT *, 0 AS delivery_id FROM log_samples UNION ALL
 SELECT * REPLACE ("timestamp" + INTERVAL 60 SECOND AS "timestamp"), 1 AS delivery_id FROM log_samples WHERE k % 3 = 0""",
    # ---- lines
    "lines": """SELECT sample_hash, n, CASE WHEN broken OR n < last THEN regexp_replace(line, '\\r$', '') ELSE line END AS line
 FROM (SELECT sample_hash, unnest(range(len(p))) AS n, unnest(p) AS line, len(p) - 1 AS last, broken FROM
 (SELECT sample_hash, ends_with(sample_content, chr(10)) AS broken, CASE WHEN sample_content = '' THEN []
   WHEN ends_with(sample_content, chr(10)) THEN string_split(left(sample_content, -1), chr(10))
   ELSE string_split(sample_content, chr(10)) END AS p FROM {base}))""",
    "texts": f"SELECT *, row_number() OVER (PARTITION BY sample_hash ORDER BY n) AS r FROM (SELECT *, {trimmed('line')} AS t FROM lines) WHERE t <> ''",
    "probe": "SELECT * FROM texts",
    "probe_scores": """SELECT sample_hash, count(*) AS n,
 sum(CASE WHEN starts_with(t, '{') AND ends_with(t, '}') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS js,
 sum(CASE WHEN NOT starts_with(t, '{') AND
  len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: contains(x, '='))) >= 2 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS lf,
 sum(CASE WHEN regexp_matches(t, '^(<|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)') THEN 1 ELSE 0 END)::DOUBLE / count(*) AS sy
 FROM probe GROUP BY sample_hash""",
    "all_scores": """SELECT sample_hash, count(*) AS n,
 sum(CASE WHEN n > 0 AND (starts_with(line, '  ') OR starts_with(line, chr(9))) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS ml
 FROM lines GROUP BY sample_hash""",
    "scores": """SELECT s.sample_hash, coalesce(p.js, 0) AS json_score, coalesce(p.lf, 0) AS logfmt_score,
 coalesce(p.sy, 0) AS syslog_score, CASE WHEN p.n > 0 AND a.n >= 4 THEN a.ml ELSE 0 END AS multiline_score
 FROM {base} s LEFT JOIN probe_scores p USING (sample_hash) LEFT JOIN all_scores a USING (sample_hash)""",
    "formats": """SELECT *, CASE WHEN best <= 0.5 THEN 'plain_text' WHEN multiline_score = best THEN 'multiline'
 WHEN syslog_score = best THEN 'syslog' WHEN logfmt_score = best THEN 'logfmt' ELSE 'json' END AS log_type
 FROM (SELECT *, greatest(json_score, logfmt_score, syslog_score, multiline_score) AS best FROM scores)""",
    "line_roles": f"""SELECT sample_hash, n, log_type, list_filter(ks, lambda x: lower(x) IN {in_list(TIMESTAMP_KEYS)})[1] AS ts,
 list_filter(ks, lambda x: lower(x) IN {in_list(LEVEL_KEYS)})[1] AS level,
 list_filter(ks, lambda x: lower(x) IN {in_list(MESSAGE_KEYS)})[1] AS msg FROM
 (SELECT sample_hash, n, log_type, CASE log_type WHEN 'json' THEN list_transform(list_filter(
   regexp_extract_all(t, '("(?:\\\\.|[^"\\\\])*"\\s*:?)', 1), lambda q: ends_with(q, ':')),
   lambda q: regexp_extract(q, '^"(.*)"', 1))
  ELSE list_transform(regexp_split_to_array(t, '\\s+'), lambda x: split_part(x, '=', 1)) END AS ks
  FROM probe JOIN formats USING (sample_hash) WHERE log_type IN ('json', 'logfmt'))""",
    "roles": """SELECT sample_hash, arg_min(ts, n) AS ts, arg_min(level, n) AS level, arg_min(msg, n) AS msg FROM
 (SELECT sample_hash, n, [ts] AS ts, [level] AS level, [msg] AS msg FROM line_roles
  WHERE coalesce(ts, level, msg) IS NOT NULL) GROUP BY sample_hash""",
    "format_rows": """SELECT f.sample_hash, log_type,
 CASE WHEN log_type = 'syslog' THEN 'timestamp' ELSE r.ts[1] END AS timestamp_field,
 CASE WHEN log_type = 'syslog' THEN 'severity' ELSE r.level[1] END AS level_field,
 CASE WHEN log_type = 'syslog' THEN 'message' ELSE r.msg[1] END AS message_field,
 log_type = 'multiline' AS multiline FROM formats f LEFT JOIN roles r USING (sample_hash)""",
    # ---- statistics
    "stats": f"""SELECT s.sample_hash, coalesce(total, 0) AS total_lines, coalesce(filled, 0) AS non_empty_lines,
 CASE WHEN total > 0 THEN (total - filled)::DOUBLE / total ELSE 0 END AS empty_line_ratio,
 CASE WHEN filled > 0 THEN bytes::DOUBLE / filled ELSE 0 END AS avg_line_length,
 CASE WHEN filled > 0 THEN uniq::DOUBLE / filled ELSE 0 END AS unique_line_ratio FROM {{base}} s LEFT JOIN
 (SELECT sample_hash, count(*) AS total, sum(f)::BIGINT AS filled, sum(CASE WHEN f = 1 THEN strlen(line) END) AS bytes,
  count(DISTINCT CASE WHEN f = 1 THEN line END) AS uniq FROM
  (SELECT *, CASE WHEN {trimmed('line')} = '' THEN 0 ELSE 1 END AS f FROM lines) GROUP BY sample_hash)
 USING (sample_hash)""",
    "stat_texts": f"""SELECT sample_hash, row_number() OVER (PARTITION BY sample_hash ORDER BY n) - 1 AS line_no, line
 FROM lines WHERE {trimmed('line')} <> ''""",
    "levels": f"""SELECT sample_hash, line_no, CASE log_type WHEN 'json' THEN {json_level('line')}
 WHEN 'logfmt' THEN {logfmt_level('line')} WHEN 'syslog' THEN {syslog_level('line')}
 ELSE {plain_level('line')} END AS level FROM stat_texts JOIN formats USING (sample_hash)""",
    # ---- signals
    "flags": f"SELECT sample_hash, n, line, {_FLAGS} FROM texts",
    "scan": f"""SELECT s.sample_hash, coalesce(score, 0) AS signal_score, coalesce(score, 0) >= 0.02 AS worth_classifying,
 coalesce(flagged, 0) AS agentic_line_count FROM {{base}} s LEFT JOIN (SELECT sample_hash,
 sum(CASE WHEN {_ANY} THEN 1 ELSE 0 END)::DOUBLE / count(*) AS score,
 sum(CASE WHEN {_ANY} THEN 1 ELSE 0 END)::BIGINT AS flagged FROM flags GROUP BY sample_hash) USING (sample_hash)""",
    "first_hits": " UNION ALL ".join(
        f"SELECT sample_hash, min(n) AS first_n, {i} AS rank, {quote(label)} AS pattern, "
        f"{quote(framework) if framework else 'CAST(NULL AS STRING)'} AS framework "
        f"FROM flags WHERE s{i} GROUP BY sample_hash"
        for i, (label, framework, _) in enumerate(SIGNALS)
    ),
    "pattern_rows": """SELECT sample_hash, row_number() OVER (PARTITION BY sample_hash ORDER BY first_n, rank) - 1 AS position,
 pattern FROM first_hits""",
    "framework_rows": "SELECT DISTINCT sample_hash, framework FROM first_hits WHERE framework IS NOT NULL",
    # ---- fields
    "json_candidates": """SELECT sample_hash, n, t FROM texts JOIN formats USING (sample_hash)
 WHERE log_type = 'json' AND starts_with(t, '{')""",
    "json_observed": """SELECT sample_hash, n, field, CASE json_type(t, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string'
 WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type
 FROM (SELECT sample_hash, n, t, unnest(json_keys(t)) AS field FROM json_candidates WHERE ends_with(t, '}') AND json_valid(t))""",
    "logfmt_candidates": """SELECT sample_hash, n, t FROM texts JOIN formats USING (sample_hash)
 WHERE log_type = 'logfmt' AND NOT starts_with(t, '{') AND contains(t, '=')""",
    "logfmt_observed": """SELECT sample_hash, n, split_part(tok, '=', 1) AS field, CASE WHEN v IN ('', 'null') THEN 'null'
 WHEN v IN ('true', 'false') THEN 'bool'
 WHEN regexp_matches(v, '^[+-]?((?i:inf|infinity|nan)|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)$') THEN 'number'
 ELSE 'string' END AS type FROM (SELECT sample_hash, n, tok, substr(tok, strpos(tok, '=') + 1) AS v FROM
 (SELECT sample_hash, n, unnest(regexp_split_to_array(t, '\\s+')) AS tok FROM logfmt_candidates) WHERE strpos(tok, '=') > 1)""",
    "observed": "SELECT * FROM json_observed UNION ALL SELECT * FROM logfmt_observed",
    "candidates": "SELECT * FROM json_candidates UNION ALL SELECT * FROM logfmt_candidates",
    "coverage": """SELECT sample_hash, parsed::DOUBLE / total AS sample_coverage, fields, parsed FROM
 (SELECT sample_hash, count(DISTINCT n) AS parsed, count(DISTINCT field) AS fields FROM observed GROUP BY sample_hash)
 JOIN (SELECT sample_hash, count(*) AS total FROM candidates GROUP BY sample_hash) USING (sample_hash)""",
    "schema_rows": f"""SELECT sample_hash, row_number() OVER (PARTITION BY sample_hash ORDER BY presence_ratio DESC, field) - 1 AS position,
 field, inferred_type, presence_ratio,
 ends_with(lower(field), 'id') OR ends_with(lower(field), '_hash') OR ends_with(lower(field), '_key') AS is_identifier FROM
 (SELECT sample_hash, field, arg_max(type, n * 10 + {_TYPE_RANK}) AS inferred_type, sum(n)::DOUBLE / max(parsed) AS presence_ratio
  FROM (SELECT sample_hash, field, type, count(*) AS n FROM observed GROUP BY ALL) JOIN coverage USING (sample_hash) GROUP BY ALL)""",
    # ---- hints and profile
    "hints": """SELECT sample_hash, log_type, skip_rule,
 CASE WHEN skip_rule IS NOT NULL THEN 'generic' WHEN log_type = 'json' THEN 'json_agent' WHEN log_type = 'logfmt' THEN 'logfmt_agent'
  WHEN log_type = 'syslog' THEN 'syslog' ELSE 'generic' END AS prompt_template,
 CASE WHEN skip_rule IS NOT NULL THEN 40 WHEN log_type = 'json' THEN 20 WHEN log_type = 'logfmt' THEN 30
  WHEN log_type = 'syslog' THEN 50 WHEN log_type = 'multiline' THEN 10 ELSE 40 END AS suggested_chunk_size,
 skip_rule IS NULL AND worth_classifying AS hint_worth,
 coalesce(skip_rule, CASE WHEN NOT worth_classifying THEN
  'agentic signal score ' || printf('%.4f', signal_score) || ' is below threshold' END) AS skip_reason,
 CASE WHEN skip_rule IS NOT NULL THEN 0 ELSE least(floor(signal_score * 100 + 0.5), 100)::INTEGER END AS priority FROM
 (SELECT *, CASE WHEN non_empty_lines = 0 THEN 'sample has no non-empty lines'
   WHEN unique_line_ratio < 0.05 THEN 'sample is highly repetitive (unique_line_ratio < 0.05)'
   WHEN avg_line_length < 10 THEN 'average line length too short to be informative' END AS skip_rule
  FROM stats JOIN scan USING (sample_hash) JOIN formats USING (sample_hash))""",
    "metadata": """SELECT l.sample_hash, l.target_id, l."timestamp" AS analyzed_at, l.k, c.signal_score, h.hint_worth, h.prompt_template,
 h.suggested_chunk_size, CASE l.k % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END AS preprocessing_version,
 CASE l.k % 6 WHEN 1 THEN 'classified' WHEN 3 THEN 'failed' ELSE 'pending' END AS classification_status
 FROM log_samples l JOIN scan c USING (sample_hash) JOIN hints h USING (sample_hash) WHERE l.k % 4 <> 3""",
    "metadata_keys": """SELECT sample_hash, k, "timestamp" AS analyzed_at,
 CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE NULL END AS preprocessing_version,
 CASE k % 6 WHEN 1 THEN 'classified' WHEN 3 THEN 'failed' ELSE 'pending' END AS classification_status
 FROM log_samples WHERE k % 4 <> 3""",
    # ---- files
    "file_targets": """SELECT 'src' || CAST(k AS STRING) AS target_id, 'box-' || CAST(k AS STRING) AS host, k,
 unnest(CASE k % 3 WHEN 0 THEN ['/data/en', '/data/fr/'] WHEN 1 THEN ['/data/de', '/data/absent']
  ELSE ['/data/es', '/data/en/a', '/data/bare'] END) AS directory,
 CASE WHEN k % 4 = 0 THEN 2 END AS max_files FROM (SELECT DISTINCT s_suppkey % 40 AS k FROM supplier)""",
    "inventory": f"SELECT {rules.FILE_TARGET} AS target_id, {rules.FILE_PATH} AS path, {rules.FILE_SIZE} AS size FROM documents",
    "found_files": """SELECT target_id, host, directory, path, size FROM (SELECT t.target_id, host, directory, path, size, max_files,
 row_number() OVER (PARTITION BY t.target_id, directory ORDER BY path) AS r FROM file_targets t JOIN inventory i
 ON i.target_id = t.target_id AND starts_with(path, rtrim(directory, '/') || '/')
 WHERE regexp_matches(path, '\\.(log|out|txt)$')) WHERE max_files IS NULL OR r <= max_files""",
    "file_texts": f"""SELECT source AS target_id, {rules.DOCUMENT_FILE} AS path, text FROM documents WHERE text <> ''
 UNION ALL SELECT 'log-' || CAST(event_id % 2 AS STRING), '/var/log/' || event_type || ' ' || CAST({rules.SEGMENT} AS STRING) || '.log',
 string_agg(line || chr(10), '' ORDER BY event_id) FROM log_lines GROUP BY ALL""",
    "file_lines": """SELECT target_id, path, strlen(text) AS file_size, unnest(range(len(p))) AS n, unnest(p) AS value FROM
 (SELECT *, CASE WHEN ends_with(text, chr(10)) THEN string_split(left(text, -1), chr(10)) ELSE string_split(text, chr(10)) END AS p
  FROM file_texts)""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY target_id, path ORDER BY n) AS line_no,
 count(*) OVER (PARTITION BY target_id, path) AS line_rows FROM file_lines""",
    "broken": """SELECT target_id, path, line_no, line_rows, file_size, value || CASE WHEN line_no = line_rows AND
 sum(strlen(value) + 1) OVER (PARTITION BY target_id, path) - file_size = 1 THEN '' ELSE chr(10) END AS raw FROM numbered""",
    "both_ends": """SELECT target_id, path, '--- BEGIN HEAD ---' || chr(10) || string_agg(raw, '' ORDER BY line_no) FILTER (line_no <= 50)
 || '--- END HEAD ---' || chr(10) || chr(10) || '--- BEGIN TAIL ---' || chr(10)
 || string_agg(raw, '' ORDER BY line_no) FILTER (line_no > line_rows - 50) || '--- END TAIL ---' || chr(10) AS sample_content,
 max(file_size) AS file_size, count(*) - count(*) FILTER (NOT ends_with(raw, chr(10))) AS line_count FROM broken GROUP BY target_id, path""",
    "cycle_files": """SELECT *, 'stored' AS processing_status, NULL AS error_details FROM both_ends
 WHERE starts_with(path, '/srv/en/') OR starts_with(path, '/srv/fr/') OR starts_with(path, '/var/log/')""",
    "cycle_dirs": """SELECT s.source AS target_id, d.directory, EXISTS (SELECT 1 FROM both_ends b WHERE b.target_id = s.source
  AND starts_with(b.path, rtrim(d.directory, '/') || '/')) AS there FROM (SELECT DISTINCT source FROM documents) s,
 (SELECT unnest(['/srv/en', '/srv/fr/', '/srv/nowhere']) AS directory) d""",
    "cycle_samples": """SELECT *, sha256(target_id || chr(0) || path || chr(0) || 'both' || chr(0) || sample_content || chr(0) || processing_status
  || chr(0) || coalesce(error_details, '')) AS sample_hash FROM
 (SELECT target_id, path, sample_content, line_count, processing_status, error_details FROM cycle_files
 UNION ALL SELECT target_id, directory, '', NULL, 'missing_directory', 'remote directory does not exist' FROM cycle_dirs WHERE NOT there)""",
    # ---- targets and classifications
    "targets": f"SELECT *, s_suppkey FROM (SELECT s_suppkey, {target_columns()} FROM supplier)",
    "replies": f"""SELECT sha256('reply-' || CAST(doc_id AS STRING)) AS sample_hash, 'target-' || CAST(doc_id % 10 AS STRING) AS target_id,
 doc_id, {rules.REPLY_TEXT} AS text, {rules.EPOCH} + doc_id * INTERVAL 1 SECOND AS received_at FROM
 (SELECT *, {rules.REPLY_BODY} AS body FROM (SELECT *, {rules.REPLY_SEVERITY} AS sev FROM labels))""",
    "bare_replies": f"""SELECT *, {trimmed("regexp_replace(regexp_replace(regexp_replace(" + trimmed('text') + ", '^(```json)+', ''), '^(```)+', ''), '(```)+$', '')")} AS j FROM replies""",
    "classifications": """SELECT sample_hash, target_id, received_at AS classified_at, doc_id,
 CASE WHEN json_type(j, '$.severity') = 'VARCHAR' AND j->>'$.severity' IN ('critical', 'warning', 'info') THEN j->>'$.severity' ELSE 'normal' END AS severity,
 CASE WHEN json_type(j, '$.summary') = 'VARCHAR' THEN j->>'$.summary' ELSE 'No summary provided.' END AS summary,
 CASE WHEN json_type(j, '$.categories') = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract(j, '$.categories') AS JSON[]),
  lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END AS categories,
 CASE WHEN json_type(j, '$.recommendations') = 'ARRAY' THEN list_transform(list_filter(CAST(json_extract(j, '$.recommendations') AS JSON[]),
  lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END AS recommendations,
 CASE WHEN json_type(j, '$.key_findings') = 'ARRAY' THEN list_transform(CAST(json_extract(j, '$.key_findings') AS JSON[]), lambda x:
  {'pattern': coalesce(x->>'$.pattern', ''), 'count': coalesce(CAST(x->>'$.count' AS BIGINT), 0),
   'severity': coalesce(x->>'$.severity', 'info'), 'example': coalesce(x->>'$.example', '')}) ELSE [] END AS key_findings,
 CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
  THEN least(1, greatest(0, CAST(j->>'$.confidence' AS DOUBLE))) ELSE 0 END AS confidence
 FROM bare_replies WHERE json_valid(j)""",
}


def sql(body: str, base: str = "samples") -> str:
    """``body`` with the expressions it needs; ``base`` is the table to profile."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name].replace("{base}", base))
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = [f"{name} AS MATERIALIZED ({CTES[name].replace('{base}', base)})" for name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body


