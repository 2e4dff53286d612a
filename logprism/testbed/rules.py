"""Rules that turn the driver's tables into log data, as plain SQL expressions."""

LEVEL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'info'
 WHEN 'click' THEN 'dbg' WHEN 'signup' THEN 'notice' ELSE 'Warning' END"""

MESSAGE = """CASE event_id % 7 WHEN 0 THEN 'tool_call search' WHEN 1 THEN 'openai chat.completions'
 WHEN 2 THEN 'rate limit 429' WHEN 3 THEN 'disk storage full' WHEN 4 THEN 'cache miss'
 WHEN 5 THEN 'heartbeat ok' ELSE 'user login' END"""

# Needs the columns lvl and msg.
LINE = """CASE WHEN event_id % 13 = 0 THEN ''
 WHEN user_id % 5 = 0 THEN '{"time":"' || CAST(CAST(ts AS DATE) AS STRING) || '","level":"' || lvl
   || '","msg":"' || msg || '","user_id":' || CAST(user_id AS STRING) || ',"ok":'
   || (CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END) || ',"ctx":' || props || '}'
 WHEN user_id % 5 = 1 THEN 'time=' || CAST(CAST(ts AS DATE) AS STRING) || ' level=' || lvl
   || ' msg="' || msg || '" trace_id=t' || CAST(event_id AS STRING) || ' n=' || CAST(event_id % 4 AS STRING)
 WHEN user_id % 5 = 2 THEN '<' || CAST(event_id % 192 AS STRING) || '>Jan 12 08:15:00 host app: ' || msg
 WHEN user_id % 5 = 3 THEN '[' || upper(lvl) || '] ' || msg || ' #' || CAST(event_id % 9 AS STRING)
 WHEN event_id % 3 = 0 THEN 'ERROR: ' || msg ELSE '  at frame ' || CAST(event_id % 5 AS STRING) END"""

# A user's log is rotated every 100,000 events of the whole table, so no sample
# holds more lines than that, however busy one user is.
SEGMENT = "CAST(floor(event_id / 100000) AS BIGINT)"

# Start of the clock for rows that carry no time of their own.
EPOCH = "TIMESTAMP '2024-02-01 00:00:00'"

# Targets, from supplier. One branch per shape of a target document.
TARGET_FIELDS = {
    "document_id": "'doc-' || CAST(s_suppkey AS STRING)",
    "target_id": """CASE s_suppkey % 11 WHEN 3 THEN '   ' WHEN 7 THEN 'pay$' || CAST(s_suppkey AS STRING)
 WHEN 9 THEN 'system.' || CAST(s_suppkey AS STRING) WHEN 5 THEN '  src' || CAST(s_suppkey AS STRING) || ' '
 ELSE 'src' || CAST(s_suppkey AS STRING) END""",
    "status": """CASE s_suppkey % 7 WHEN 1 THEN 'Active' WHEN 2 THEN ' ACTIVE ' WHEN 3 THEN 'paused'
 WHEN 4 THEN NULL ELSE 'active' END""",
    "host": """CASE s_suppkey % 11 WHEN 0 THEN 'web-' || CAST(s_suppkey AS STRING) WHEN 1 THEN ' ' ELSE NULL END""",
    "hostname": """CASE WHEN s_suppkey % 11 IN (2, 3, 5, 7) OR s_suppkey % 53 = 0 THEN 'app-' || CAST(s_suppkey AS STRING) ELSE NULL END""",
    "ip": """CASE WHEN s_suppkey % 11 = 4 THEN '10.0.0.' || CAST(s_suppkey % 250 AS STRING) ELSE NULL END""",
    "port": """CASE WHEN s_suppkey % 4 = 1 THEN 2200 + s_nationkey WHEN s_suppkey % 41 = 2 THEN 70000 ELSE NULL END""",
    "username": """CASE WHEN s_suppkey % 3 = 0 THEN 'ops' ELSE NULL END""",
    "password": """CASE s_suppkey % 13 WHEN 0 THEN 'pw' WHEN 1 THEN '  ' ELSE NULL END""",
    "private_key_path": """CASE s_suppkey % 13 WHEN 2 THEN '/keys/a' WHEN 3 THEN ' ' ELSE NULL END""",
    "private_key": """CASE s_suppkey % 13 WHEN 4 THEN 'inline-key' ELSE NULL END""",
    # Log directories as one text, parts split at '|'; NULL where the field is absent.
    "log_paths": """CASE s_suppkey % 5 WHEN 0 THEN '/data/en| /data/fr ' WHEN 1 THEN '/data/de'
 WHEN 2 THEN ' |' ELSE NULL END""",
    "conn_host": """CASE WHEN s_suppkey % 11 IN (1, 6, 8, 9) THEN 'db-' || CAST(s_suppkey AS STRING) ELSE NULL END""",
    "conn_port": """CASE WHEN s_suppkey % 6 = 2 THEN 2022 ELSE NULL END""",
    "conn_user": """CASE WHEN s_suppkey % 3 <> 2 THEN ' svc ' ELSE NULL END""",
    "conn_paths": """CASE WHEN s_suppkey % 5 = 3 THEN '/data/es|/data/absent' ELSE NULL END""",
    "auth_method": """CASE s_suppkey % 13 WHEN 5 THEN ' Password ' WHEN 6 THEN 'KEY' WHEN 7 THEN 'kerberos'
 WHEN 8 THEN 'key' ELSE NULL END""",
    "cred_password": """CASE s_suppkey % 13 WHEN 5 THEN 'pw2' ELSE NULL END""",
    "cred_private_key_path": """CASE s_suppkey % 13 WHEN 6 THEN '/keys/b' ELSE NULL END""",
    "max_files": """CASE WHEN s_suppkey % 10 = 0 THEN 3 ELSE NULL END""",
}

# Log files on storage, one per document; names hold signs that paths encode.
DOCUMENT_FILE = "'/srv/' || lang || '/a b+é%' || CAST(doc_id AS STRING) || '.txt'"

# File inventory, from documents: one file per document.
FILE_TARGET = "'src' || CAST(doc_id % 40 AS STRING)"
FILE_DIRECTORY = "'/data/' || lang"
FILE_PATH = """'/data/' || lang || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/a' WHEN 2 THEN '/a/b' ELSE '/a/b/c' END
 || '/' || source || '-' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.out'
 WHEN 2 THEN '.txt' WHEN 3 THEN '.gz' ELSE '.log.txt' END"""
FILE_SIZE = "CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END"

# Model replies, from labels. The text has one of eight shapes by doc_id.
REPLY_SEVERITY = """CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'warning'
 WHEN quality = 0 THEN 'info' ELSE 'normal' END"""
# Needs the column sev.
REPLY_BODY = """'{"severity":"' || sev || '","categories":["error",3,"c' || CAST(doc_id % 4 AS STRING)
 || '"],"summary":"doc ' || CAST(doc_id AS STRING) || ' looks ' || sev
 || '","key_findings":[{"pattern":"p' || CAST(doc_id % 3 AS STRING) || '","count":' || CAST(doc_id % 9 AS STRING)
 || ',"severity":"' || sev || '","example":"line ' || CAST(doc_id AS STRING)
 || '"},{"pattern":"q"}],"recommendations":["restart","scale ' || CAST(doc_id % 5 AS STRING)
 || '",7],"confidence":' || CAST(doc_id % 100 AS STRING) || '.5e-2}'"""
# Needs the column body.
REPLY_TEXT = """CASE doc_id % 8 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
 WHEN 2 THEN '  ```' || body || '```  ' WHEN 3 THEN 'Sorry, no JSON here'
 WHEN 4 THEN '{"severity":"Critical","categories":"error","confidence":"high"}'
 WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"severity":"' || sev || '","confidence":7,"summary":5}' ELSE body END"""
