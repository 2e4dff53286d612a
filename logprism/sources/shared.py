"""The folder that all executors and the driver share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for ``name`` below the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may do without the setting; it gets a temporary folder.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="logprism-")
    return f"{base.rstrip('/')}/{name}"
