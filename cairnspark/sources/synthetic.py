"""Generated inputs: one large file in blocks, or many files of which one group is identical."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65_536
PROFILES = ("compressible-text", "stored-binary")


def blocks(spark: SparkSession, size: int, profile: str = "compressible-text", block: int = BLOCK) -> DataFrame:
    """position, content of a file of ``size`` bytes; blocks are made where they are used, so size costs no memory."""
    if profile not in PROFILES or size < 1:
        raise ValueError("unknown profile, or no size")
    length = F.least(F.lit(block), F.lit(size) - F.col("id") * block).cast("int")
    if profile == "compressible-text":
        whole = F.rpad(F.lit("synthetic block\n"), block, " ").cast("binary")
    else:
        whole = F.unhex(F.repeat(F.lit(bytes(range(256)).hex()), -(-block // 256)))
    return spark.range(-(-size // block)).select(F.col("id").alias("position"), F.substring(whole, F.lit(1), length).alias("content"))


def files(spark: SparkSession, count: int, size: int, groups: int) -> DataFrame:
    """position, path, content of ``count`` text files: those of group 0 are identical, all others name their position."""
    if count < 1 or size < 1 or groups < 1:
        raise ValueError("count, size and groups are positive")
    group = F.col("id") % groups
    name = F.when(group == 0, F.lit("group zero ")).otherwise(F.format_string("group %d file %d ", group, F.col("id")))
    path = F.format_string("group-%04d/file-%08d.txt", group, F.col("id"))
    text = F.substring(F.repeat(name, size), 1, size)
    return spark.range(count).select(F.col("id").alias("position"), path.alias("path"), text.alias("content"))
