"""Content keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_hash() -> Column:
    """SHA-256 over what makes a sample the same sample: its target, file, mode,
    content, status and error, joined by NUL. Host, path, sizes and time do not count."""
    return F.sha2(
        F.concat_ws(
            "\0",
            "target_id",
            "source_file",
            "sampling_mode",
            "sample_content",
            "processing_status",
            F.coalesce(F.col("error_details"), F.lit("")),
        ),
        256,
    )
