"""Session settings the jobs rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings that change results, so every entry point applies them.
REQUIRED_CONF = {
    # JSON objects with a repeated key keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that decide results; leave sizing to the cluster.

    Python workers are told where this package lies, so that a driver started elsewhere can use it."""
    _workers_find_package(spark)
    for name, value in REQUIRED_CONF.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def _workers_find_package(spark: SparkSession) -> None:
    here, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join([here, *known])


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sessionloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SESSIONLOOM_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by the cluster; `fallback` applies only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if fallback is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    return fallback

