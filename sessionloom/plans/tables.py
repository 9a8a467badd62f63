"""The shared parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sessionloom.session import checkpoint_folder, configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in tests."""
    try:
        return checkpoint_folder(spark).rstrip("/")
    except ValueError:
        return tempfile.mkdtemp(prefix="loom-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
