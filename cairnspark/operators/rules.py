"""Integrity rules as data: each rule is a predicate, and every violation is a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .manifest import CODECS, KINDS, below

Rule = tuple[str, Column]


def violations(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """key, rule for each broken rule; one pass over the rows whatever the number of rules."""
    broken = F.array_compact(F.array(*(F.when(predicate, F.lit(name)) for name, predicate in rules)))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def entry_rules() -> list[Rule]:
    """Rules that one catalogue row decides."""
    path, kind, target = F.col("path"), F.col("kind"), F.col("target")
    return [
        ("path", ~T.archive_path_ok(path)),
        ("entry-id", F.coalesce(F.trim("entry_id"), F.lit("")) == ""),
        ("kind", ~F.coalesce(kind.isin(*KINDS), F.lit(False))),
        ("mode", ~F.col("mode").between(0, 0o7777)),
        ("mtime", F.col("mtime_ns") < 0),
        ("target-missing", (kind == "symlink") & (target.isNull() | (target == "") | target.contains("\0") | (F.octet_length(target) > 4096))),
        ("target-unexpected", (kind != "symlink") & target.isNotNull()),
        ("sha256", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("chunk-id", F.coalesce(F.trim("chunk_id"), F.lit("")) == ""),
        ("sizes", F.least("size", "chunk_offset", "chunk_length") < 0),
        ("stored-size", F.col("stored_size") != F.col("chunk_length")),
        ("codec", ~F.coalesce(F.col("codec").isin(*CODECS), F.lit(False))),
        ("searchable", F.col("searchable").isNull()),
    ]


def duplicates(rows: DataFrame, column: str, rule: str, key: str) -> DataFrame:
    """key, rule for the rows beyond the first with an equal value; counted before anything is joined."""
    again = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("position").alias("first")).where("n > 1").select(column, "first")
    return rows.join(again, column).where("position <> first").select(F.col(key), F.lit(rule).alias("rule"))


def manifest_violations(rows: DataFrame, key: str = "position", data_length: int | None = None) -> DataFrame:
    """All broken rules of a catalogue: those of single rows, duplicates, and paths written through a link."""
    found = [violations(rows, key, entry_rules()), duplicates(rows, "path", "duplicate-path", key), duplicates(rows, "entry_id", "duplicate-entry-id", key)]
    links = rows.where("kind = 'symlink'").select(F.col("path").alias("prefix")).distinct()
    found.append(below(rows, links, "left_semi").select(F.col(key), F.lit("through-link").alias("rule")))
    if data_length is not None:
        found.append(violations(rows, key, [("chunk-bounds", F.col("chunk_offset") + F.col("chunk_length") > data_length)]))
    return reduce(DataFrame.unionByName, found)


def total_violations(rows: DataFrame, entry_count: int, raw_bytes: int) -> DataFrame:
    """Totals that the manifest states and its entries don't give."""
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return violations(totals.withColumn("scope", F.lit("manifest")), "scope", [("entry-count", F.col("n") != entry_count), ("raw-bytes", F.col("bytes") != raw_bytes)])


def path_violations(rows: DataFrame, key: str, path: Column, ending: str | None = None) -> DataFrame:
    """key, ok for archive paths, or remote paths where an ending is given."""
    return rows.select(key, (T.archive_path_ok(path) if ending is None else T.remote_path_ok(path, ending)).alias("ok"))


def header_rules(magic: int = 5, header: int = 8192) -> list[Rule]:
    """Sections tile the file without gaps."""
    return [
        ("header", (F.col("header_offset") != magic) | (F.col("header_length") != header)),
        ("manifest", (F.col("manifest_offset") != magic + header) | (F.col("manifest_length") <= 0)),
        ("index", (F.col("index_offset") != F.col("manifest_offset") + F.col("manifest_length")) | (F.col("index_length") <= 0)),
        ("data", (F.col("data_offset") != F.col("index_offset") + F.col("index_length")) | (F.col("data_length") < 0)),
        ("size", F.col("archive_size") != F.col("data_offset") + F.col("data_length")),
        ("digest", ~(F.col("manifest_sha256").rlike("^[0-9a-f]{64}$") & F.col("index_sha256").rlike("^[0-9a-f]{64}$"))),
    ]


def telemetry_rules() -> list[Rule]:
    """Metadata questions take three ranges, or none and two sidecars, and never touch payload."""
    ranges, sidecars = F.col("range_reads"), F.col("sidecar_reads")
    return [("reads", ~(((ranges == 3) & (sidecars == 0)) | ((ranges == 0) & (sidecars == 2)))), ("data-section", F.col("data_section_read")), ("bytes", F.col("bytes_read") <= 0)]


def descriptor_rules() -> list[Rule]:
    """A search descriptor is ready with a model and dimensions, or unavailable without."""
    ready = F.col("status") == "ready"
    return [
        ("status", ~F.col("status").isin("ready", "unavailable")), ("metric", ~F.col("metric").isin("cosine", "dot", "l2")), ("index-ref", ~F.col("index_ref").isin("none", "native", "embedded", "sidecar", "external")),
        ("ready-model", ready & (F.coalesce(F.trim("model_id"), F.lit("")) == "")), ("ready-dimensions", ready & ~F.coalesce(F.col("dimensions") > 0, F.lit(False))), ("ready-ref", ready & (F.col("index_ref") == "none")),
        ("unavailable-ref", ~ready & (F.col("index_ref") != "none")), ("unavailable-model", ~ready & (F.col("model_id").isNotNull() | F.col("dimensions").isNotNull())),
    ]


def descriptor_mismatch(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, in_left, in_right where two one-row descriptors differ; nulls are values."""
    pack = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select("x.*")
    both = pack(left, "in_left").join(pack(right, "in_right"), "field")
    return both.where(~F.col("in_left").eqNullSafe(F.col("in_right")))


def first_by(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
