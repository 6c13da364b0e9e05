"""Entry catalogue: digests, chunk layout with dedup, and the reports made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lineage, policy
from ..functions import text as T

KINDS = ("file", "symlink", "dir")
CODECS = ("store", "deflate", "zstd")


def entries(files: DataFrame, indexed: bool = True) -> DataFrame:
    """Catalogue rows of files(position, path, kind, size, sha256); ids are positions of the walk, so gaps stay."""
    return files.select(
        T.numbered("e", F.col("position")).alias("entry_id"), "position", "path", "kind", "size", "sha256",
        F.when(F.col("kind") == "file", policy.media_type(F.col("path"))).otherwise("application/octet-stream").alias("media_type"),
        policy.requested_method(F.col("path")).alias("requested_method"), policy.default_codec(F.col("path")).alias("codec"), policy.searchable(F.col("path"), F.col("kind"), indexed).alias("searchable"),
    )


def chunk_layout(rows: DataFrame, dedup: bool = True, length: str = "size") -> DataFrame:
    """``rows`` (position, entry_id, sha256, length) with chunk_id, chunk_offset, chunk_length and dedup_of.

    With ``dedup`` the first row of each digest owns the chunk, else every row owns one.  Chunks are numbered and
    laid end to end in the order of their first use.
    """
    key = "sha256" if dedup else "position"
    owner = F.struct("position", "entry_id", "sha256", F.col(length).cast("long").alias("chunk_length"))
    owners = rows.groupBy("sha256").agg(F.min(owner).alias("o")).select("o.*") if dedup else rows.select(owner.alias("o")).select("o.*")
    owners = lineage.running(owners, "position", {"ordinal": "1L", "chunk_offset": "chunk_length"})
    named = owners.select(key, F.concat(T.numbered("c", F.col("ordinal")), F.lit("-"), F.substring("sha256", 1, 16)).alias("chunk_id"), "chunk_offset", "chunk_length", F.col("entry_id").alias("owner"))
    return rows.join(named, key).withColumn("dedup_of", F.when(F.col("owner") != F.col("entry_id"), F.col("owner"))).drop("owner")


def dedup_summary(layout: DataFrame) -> DataFrame:
    out = layout.agg(F.count("*").alias("entries"), F.count("dedup_of").alias("dedup_entries"), F.sum(F.when(F.col("dedup_of").isNull(), F.col("chunk_length")).otherwise(0)).alias("unique_bytes"), F.sum("size").alias("raw_bytes"))
    return out.withColumn("unique_entries", F.col("entries") - F.col("dedup_entries")).withColumn("dedup_ratio", T.share(F.col("dedup_entries"), F.col("entries"), 6))


def kind_counts(rows: DataFrame) -> DataFrame:
    """A row for each kind, also for those that don't occur."""
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS)).select(F.expr("stack(3, " + ", ".join(f"'{k}', `{k}`" for k in KINDS) + ") AS (kind, entries)"))


def method_counts(rows: DataFrame) -> DataFrame:
    """Entries, copies included, by codec."""
    return rows.groupBy("codec").agg(F.count("*").alias("entries"))


def savings(raw, packed) -> list:
    return [(raw - packed).alias("saved_bytes"), T.percent(raw - packed, raw).alias("saved_pct")]


def info(layout: DataFrame) -> DataFrame:
    """Totals of a catalogue with its layout."""
    raw, packed = F.sum("size"), F.sum(F.when(F.col("dedup_of").isNull(), F.col("chunk_length")).otherwise(0))
    base = layout.agg(F.count("*").alias("entry_count"), raw.alias("raw_bytes"), packed.alias("data_length"), F.count_if("searchable").alias("searchable"), F.count_if(F.col("kind") != "file").alias("special"), F.countDistinct("chunk_id").alias("chunks"))
    return base.select("*", *savings(F.col("raw_bytes"), F.col("data_length")), F.when(F.col("special") > 0, 2).otherwise(1).alias("format_version")).drop("special")


def section_ranges(manifest_bytes: int, index_bytes: int, df: DataFrame, magic_bytes: int = 5, header_bytes: int = 8192) -> DataFrame:
    """The three byte ranges that answer any question about metadata."""
    header, manifest = magic_bytes + header_bytes, magic_bytes + header_bytes + manifest_bytes
    return df.sparkSession.createDataFrame([("header", 0, header), ("manifest", header, manifest_bytes), ("index", manifest, index_bytes)], "section string, offset long, length long")


def out_of_bounds(layout: DataFrame, data_length: int) -> DataFrame:
    return layout.where((F.col("chunk_offset") < 0) | (F.col("chunk_length") < 0) | (F.col("chunk_offset") + F.col("chunk_length") > data_length))


def below(paths: DataFrame, prefixes: DataFrame, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` of paths(path, ...) with those that lie below a path of prefixes(prefix).

    Each path's ancestors are exploded, so this is an equi join and not a comparison of all pairs.
    """
    deep = paths.select("path", F.explode(T.ancestors(F.col("path"))).alias("prefix")).join(prefixes.select("prefix"), "prefix", "left_semi").select("path").distinct()
    return paths.join(deep, "path", how)


def protected_prune(paths: DataFrame) -> DataFrame:
    """Kept paths and the outermost protected paths: path, verdict.  What lies below a protected path isn't reported."""
    outer = F.filter(F.array_append(T.ancestors(F.col("path")), F.col("path")), policy.has_protected_part)
    rows = paths.select("path", F.try_element_at(outer, F.lit(1)).alias("root"))
    kept = rows.where("root IS NULL").select("path", F.lit("kept").alias("verdict"))
    return kept.unionByName(rows.where("path = root").select("path", F.lit("protected").alias("verdict")))


def alignment(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Index documents that match no entry (unknown) or one of another path (path): entry_id, problem."""
    left = documents.select("entry_id", F.col("path").alias("document_path"))
    joined = left.join(rows.select("entry_id", "path"), "entry_id", "left")
    return joined.select("entry_id", F.when(F.col("path").isNull(), "unknown").when(F.col("path") != F.col("document_path"), "path").alias("problem")).where("problem IS NOT NULL")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, repeats counted: side and all columns."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def restore_check(manifest: DataFrame, restored: DataFrame) -> DataFrame:
    """path, problem for every entry whose restored copy differs; paths that no entry names are extra."""
    m = manifest.select("path", F.col("kind").alias("m_kind"), F.col("sha256").alias("m_sha"), F.col("size").alias("m_size"))
    r = restored.select("path", F.col("kind").alias("r_kind"), F.col("sha256").alias("r_sha"), F.col("size").alias("r_size"))
    problem = (
        F.when(F.col("r_kind").isNull(), "missing").when(F.col("m_kind").isNull(), "extra").when(F.col("m_kind") != F.col("r_kind"), "kind")
        .when(F.col("m_size") != F.col("r_size"), "size").when(F.col("m_sha") != F.col("r_sha"), "content")
    )
    return m.join(r, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def restore_verdict(problems: DataFrame, head: int = 20) -> DataFrame:
    """Count by problem, with the first paths of each.

    The count is combined on the map side; of the paths each task keeps the first ones, so no list grows with a problem.
    """
    first = problems.withColumn("_rank", F.row_number().over(Window.partitionBy("problem").orderBy("path"))).where(F.col("_rank") <= head)
    first = first.groupBy("problem").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("first_paths"))
    return problems.groupBy("problem").agg(F.count("*").alias("paths")).join(first, "problem")
