"""Logs, limits and benchmark figures as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The columns that logs may hold.
SAVINGS_FIELDS = ("schema_version", "timestamp", "operation", "archive", "disk", "project", "raw_bytes", "packed_bytes", "saved_bytes", "saved_pct", "methods", "remote_path")
ACTION_FIELDS = ("schema_version", "timestamp", "operation", "disk", "project", "remote_path", "status", "detail")
MIB = 1_048_576


def redact(rows: DataFrame, allowed: tuple[str, ...], now: Column | None = None) -> DataFrame:
    """Allowed columns only, with defaults for the version and the time."""
    kept = rows.select(*(c for c in rows.columns if c in allowed))
    version = F.coalesce(F.col("schema_version"), F.lit(1)) if "schema_version" in kept.columns else F.lit(1)
    stamp = F.coalesce(F.col("timestamp"), now) if "timestamp" in kept.columns and now is not None else F.col("timestamp") if "timestamp" in kept.columns else (now if now is not None else F.lit(None).cast("string"))
    return kept.withColumns({"schema_version": version.cast("long"), "timestamp": stamp})


def savings_summary(log: DataFrame) -> DataFrame:
    """Totals of a savings log; a missing figure counts as 0 and what was saved is computed anew."""
    raw, packed = F.coalesce(F.sum("raw_bytes"), F.lit(0)), F.coalesce(F.sum("packed_bytes"), F.lit(0))
    return log.agg(F.count("*").alias("records"), raw.alias("raw_bytes"), packed.alias("packed_bytes")).withColumn("saved_bytes", F.col("raw_bytes") - F.col("packed_bytes"))


def skip_summary(skipped: DataFrame) -> DataFrame:
    """Paths by reason, and in all: reason ``total``."""
    return skipped.rollup("reason").agg(F.count("*").alias("paths"), F.grouping("reason").alias("_all")).select(F.when(F.col("_all") == 1, "total").otherwise(F.col("reason")).alias("reason"), "paths")


def within_week(rows: DataFrame, path: str, root: str, project: str, week: int) -> DataFrame:
    """Rows at or below the folder of a project's week; the week has two digits."""
    base = f"{root}/{project}/{week:02d}"
    return rows.where((F.col(path) == base) | F.col(path).startswith(base + "/"))


def negative_savings(rows: DataFrame) -> DataFrame:
    """Archives that grew, with a warning."""
    saved = F.col("raw_bytes") - F.col("packed_bytes")
    return rows.where(saved < 0).withColumns({"saved_bytes": saved, "warning": F.format_string("grew by %d bytes (%.2f%%)", -saved, -T.percent(saved, F.col("raw_bytes")))})


def slo(runs: DataFrame, rss_bytes: int, pack_ratio: float, unpack_ratio: float, allowance: int) -> DataFrame:
    """Limits of each run(operation, size_bytes, peak_rss_bytes, temp_bytes) and whether it keeps them."""
    ratio = F.when(F.col("operation") == "pack", F.lit(pack_ratio)).otherwise(F.lit(unpack_ratio))
    limit = F.floor(F.col("size_bytes") * ratio + F.lit(float(allowance))).cast("long")
    out = runs.withColumns({"temp_limit": limit, "rss_ok": F.col("peak_rss_bytes") <= rss_bytes})
    out = out.withColumn("temp_ok", F.col("temp_bytes") <= F.col("temp_limit"))
    return out.withColumn("passed", F.col("rss_ok") & F.col("temp_ok"))


def spread(runs: DataFrame, most: int) -> DataFrame:
    """Between the least and greatest peak by operation."""
    out = runs.groupBy("operation").agg((F.max("peak_rss_bytes") - F.min("peak_rss_bytes")).alias("spread_bytes"), F.count("*").alias("runs"))
    return out.withColumn("within", F.col("spread_bytes") <= most)


def throughput(runs: DataFrame) -> DataFrame:
    """MiB a second to 3 places and staging over input to 6; null where no finite positive time is known."""
    fine = (F.col("seconds") > 0) & ~F.isnan("seconds") & (F.col("seconds") < float("inf"))
    rate = F.when(fine, F.bround(F.col("size_bytes") / MIB / F.col("seconds"), 3))
    return runs.withColumns({"mib_per_second": rate, "temp_ratio": F.bround(F.col("temp_bytes") / F.col("size_bytes"), 6)})


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def passed(runs: DataFrame) -> DataFrame:
    return runs.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failures"))
