"""Exact dedup by skew-safe combining: local, salted, global, comparing whole texts each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, fresh, spread_by_class


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001, salts: int = 64, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Three combining steps, each grouped by the whole text
    beside its digest, so that equal digests of different texts never merge:

    1. local: the map side of the aggregation keeps one row per text and task, hot or not;
    2. salted: digests that hold at least ``hot_share`` of all rows (so at most 1 / hot_share of them) are dealt
       to ``salts`` reducers by the number of the task that combined them, all others have one salt;
    3. global: the salt winners of the hot digests meet; a cold digest is whole after step 2 and travels without
       its text.

    The class of a row follows from its digest alone where step 3 left one class for that digest.  Where two texts
    share a digest (``digest_bytes`` below 32 makes that testable) rows are matched by text.

    Null text counts as empty, and all empty texts are one group.  The row with the largest doc_id stays; a null
    doc_id loses to any other and is never kept.  Repeated rows with the same doc_id and text are all marked kept
    when that doc_id wins.  A very long text is a key like any other: it meets only its equals, and an aggregation
    that outgrows its memory sorts and spills.  An empty table gives no rows.  Other columns are ignored.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm"))
    text = text.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    digest = F.substring("sha", 1, digest_bytes).alias("digest")
    members = durable(text.select("doc_id", "sha"))
    total = members.count()
    hot = members.groupBy(digest).count().where(F.col("count") >= max(2.0, total * hot_share)).select("digest", F.lit(True).alias("hot"))
    hot = F.broadcast(durable(hot.repartition(1)))  # at most 1 / hot_share rows

    salt = F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0).alias("salt")
    salted = text.select("doc_id", "norm", digest).join(hot, "digest", "left").select("doc_id", "norm", "digest", "hot", salt)
    winners = salted.groupBy("digest", "hot", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    alone = F.when(F.col("hot").isNull(), F.struct(F.xxhash64("norm"), F.octet_length("norm"), F.col("keep_id")))
    classes = winners.groupBy("digest", F.when(F.col("hot"), F.col("norm")).alias("hot_norm"), alone.alias("cold")).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = durable(classes.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")))

    out = spread_by_class(members.select("doc_id", "sha", digest), classes.where("texts = 1").drop("texts"), "digest", hot).drop("digest")
    clashing = classes.where("texts > 1").select("digest")
    if not clashing.isEmpty():
        rows = text.select("doc_id", "norm", "sha", digest).join(clashing, "digest", "left_semi")
        exact = rows.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(rows.join(exact, ["digest", "norm"]).select("doc_id", "sha", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, with all its own columns, whatever their names.

    Rows with a null id stay only where no other row has their text; of several rows with the winning id and text,
    or of a text that only null ids have, one stays, whichever it is.  Those repeats are found by digest and salt
    first, so that many of them do not meet in one task.
    """
    sha, drop_id, drop_sha, salt = fresh(docs.columns, "cairn_sha", "cairn_drop_id", "cairn_drop_sha", "cairn_salt")
    found = exact_dedup(docs, id_col, text_col)
    marked = docs.withColumn(sha, F.sha2(ascii_lower(F.col(text_col)), 256))
    dropped = found.where(~F.col("kept") & F.col("keep_id").isNotNull()).select(F.col("doc_id").alias(drop_id), F.col("text_sha256").alias(drop_sha)).distinct()
    out = marked.join(dropped, F.col(id_col).eqNullSafe(F.col(drop_id)) & (F.col(sha) == F.col(drop_sha)), "left_anti")
    if not found.where(F.col("kept") | F.col("keep_id").isNull()).groupBy("text_sha256").count().where("count > 1").isEmpty():
        out = out.withColumn(salt, F.spark_partition_id() % 64).dropDuplicates([sha, salt]).dropDuplicates([sha])
    return out.drop(sha, salt)


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
