"""Session settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitting side sets master and sizes, and only the rest applies."""
    return (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
