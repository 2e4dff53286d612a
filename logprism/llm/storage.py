"""Intermediate tables and files in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import io
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from logprism.sources.shared import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; no two calls get the same."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this library wherever the driver found it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    folder = scratch(spark, "package")
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{package.name}.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(context.applicationId)


def read_columns(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(*columns) if columns else rows


def release_memory() -> None:
    """Gives back what a task's arrays took: Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, for use inside a task."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
