"""Table schemas as DDL text. Reads are permissive and never infer a type."""

from __future__ import annotations

from logprism.operators.fields import SCHEMA_TYPE
from logprism.operators.formats import FORMAT_TYPE


def _ddl(text: str) -> str:
    return " ".join(text.split())


# A target document as users write it: every field may be missing, several have
# alternative names, and connection details may sit in a nested object.
_ENDPOINT = """host string, hostname string, server string, ip string, port long, ssh_port long,
    username string, `user` string, log_paths array<string>, log_dirs array<string>,
    log_directories array<string>, folders array<string>, paths array<string>"""
RAW_TARGET = _ddl(
    f"""document_id string, target_id string, status string, {_ENDPOINT},
    password string, private_key string, private_key_path string, private_key_file string,
    private_key_passphrase string, sample_line_count long, max_files long,
    connection struct<{_ENDPOINT}>,
    credentials struct<auth_method string, password string, private_key string,
      private_key_path string, private_key_file string, passphrase string>,
    _malformed string"""
)

SAMPLE = _ddl(
    """timestamp timestamp, target_id string, source_file string, sample_content string, host string,
    path string, sampling_mode string, line_count long, file_size_bytes long,
    processing_status string, error_details string, sample_hash string"""
)

SAMPLE_METADATA = _ddl(
    f"""sample_hash string, target_id string, analyzed_at timestamp, preprocessing_version string,
    format {FORMAT_TYPE},
    stats struct<total_lines:long,non_empty_lines:long,empty_line_ratio:double,avg_line_length:double,
      time_span_secs:long,level_distribution:map<string,long>,unique_line_ratio:double>,
    agentic_scan struct<signal_score:double,worth_classifying:boolean,detected_frameworks:array<string>,
      matched_patterns:array<string>,agentic_line_count:long>,
    schema {SCHEMA_TYPE},
    ingestion_hints struct<prompt_template:string,suggested_chunk_size:int,worth_classifying:boolean,
      skip_reason:string,priority:int>,
    classification_status string"""
)

CLASSIFICATION = _ddl(
    """sample_hash string, target_id string, classified_at timestamp, model string, severity string,
    categories array<string>, summary string,
    key_findings array<struct<pattern:string,count:long,severity:string,example:string>>,
    recommendations array<string>, confidence double, input_tokens long, output_tokens long,
    classification_version string"""
)

TRACKING_LOG = _ddl("timestamp timestamp, level string, message string")
