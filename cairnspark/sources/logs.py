"""Append-only JSON-lines logs."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports

SAVINGS = "schema_version long, timestamp string, operation string, archive string, disk string, project string, raw_bytes long, packed_bytes long, saved_bytes long, saved_pct double, methods map<string,long>, remote_path string"
ACTIONS = "schema_version long, timestamp string, operation string, disk string, project string, remote_path string, status string, detail string"


def append(rows: DataFrame, folder: str, allowed: tuple[str, ...] = reports.SAVINGS_FIELDS, now: Column | None = None) -> None:
    """Add rows to a log; columns that a log may not hold are left out, and nulls aren't written."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if now is None else now
    reports.redact(rows, allowed, stamp).write.mode("append").json(folder)


def read(spark: SparkSession, folder: str, schema: str = SAVINGS) -> DataFrame:
    """A log as a table; a log that isn't there yet is empty, and blank lines are passed over."""
    if "://" not in folder and not (os.path.isfile(folder) or glob.glob(os.path.join(folder, "*.json*"))):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(folder)
