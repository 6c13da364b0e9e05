"""Lexical index and ranked search: term overlap, OR semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_LIMIT, MOST_LIMIT = 20, 100


class SearchError(ValueError):
    """A request that is refused before anything is planned."""


def checked_limit(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST_LIMIT:
        raise SearchError(f"the limit must be an integer from 1 to {MOST_LIMIT}")
    return limit


def index_documents(entries: DataFrame, content: str = "content", provided: str | None = None) -> DataFrame:
    """entry_id, path, excerpt, terms.  Path words are always indexed; ``provided`` terms replace content words."""
    words = T.terms(F.col("path"), F.col(content) if provided is None else F.array_join(F.col(provided), " "))
    return entries.select("entry_id", "path", T.excerpt(F.col(content)).alias("excerpt"), words.alias("terms"))


def postings(documents: DataFrame) -> DataFrame:
    """term, entry_id: one row each, since terms are distinct within a document.

    An inner explode would first filter on the size of the terms and so make them twice.
    """
    return documents.select(F.explode_outer("terms").alias("term"), "entry_id").where("term IS NOT NULL")


def posting_lists(documents: DataFrame) -> DataFrame:
    """term, entries (count) and the least and greatest entry: what a reader needs to plan, with bounded rows."""
    return postings(documents).groupBy("term").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry"))


def query_terms(query: str, df: DataFrame) -> list[str]:
    """Distinct words of a query, folded by the same expression as the documents."""
    if not isinstance(query, str):
        raise SearchError("the query must be a string")
    return df.sparkSession.range(1).select(T.terms(F.lit(query)).alias("t")).first()["t"]


def ranked(hits: DataFrame, n_terms: int, limit: int | None) -> DataFrame:
    out = hits.withColumn("score", T.half_even(F.col("hits") / n_terms, 4)).drop("hits").orderBy(F.desc("score"), "path")
    return out if limit is None else out.limit(limit)


def search(documents: DataFrame, query: str, limit: int = DEFAULT_LIMIT, all_terms: bool = False) -> DataFrame:
    """entry_id, path, excerpt, score, matched_terms of the best documents, by rounded score and then path.

    A scan: each document is scored where it is read and only each task's best rows travel.  Documents without a
    hit sort last and are dropped behind the limit; a filter before it would make the terms of each document twice.
    """
    limit = checked_limit(limit)
    wanted = query_terms(query, documents)
    if not wanted:
        return documents.where(F.lit(False)).select("entry_id", "path", "excerpt", F.lit(0.0).alias("score"), F.lit("").alias("matched_terms"))
    matched = F.array_intersect(F.array(*map(F.lit, wanted)), F.col("terms"))
    hits = documents.withColumn("matched", matched).select("entry_id", "path", "excerpt", F.array_join("matched", " ").alias("matched_terms"), F.size("matched").alias("hits"))
    best = ranked(hits, len(wanted), limit).select("entry_id", "path", "excerpt", "score", "matched_terms")
    return best.where(F.size(F.split("matched_terms", " ")) == len(wanted) if all_terms else F.col("matched_terms") != "")


def search_index(index: DataFrame, documents: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The same from stored postings: the terms are pushed into the scan, and hits are joined to their documents."""
    limit = checked_limit(limit)
    wanted = query_terms(query, documents)
    if not wanted:
        return search(documents, query, limit)
    hits = index.where(F.col("term").isin(wanted)).groupBy("entry_id").agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_list("term")), " ").alias("matched_terms"))
    named = hits.join(documents.select("entry_id", "path", "excerpt"), "entry_id", "left").withColumns({"path": F.coalesce("path", F.lit("")), "excerpt": F.coalesce("excerpt", F.lit(""))})
    return ranked(named, len(wanted), limit).select("entry_id", "path", "excerpt", "score", "matched_terms")


def search_batch(documents: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, rank, entry_id, score of the best documents of each row of queries(query_id, query).

    Query terms meet postings by an equi join, counts combine on the map side, and the group limit is applied
    before the shuffle by query.
    """
    limit = checked_limit(limit)
    asked = queries.select("query_id", T.terms(F.col("query")).alias("terms")).withColumn("n_terms", F.size("terms"))
    hits = postings(documents).join(asked.select("query_id", "n_terms", F.explode_outer("terms").alias("term")), "term").groupBy("query_id", "n_terms", "entry_id").agg(F.count("*").alias("hits"))
    scored = hits.select("query_id", "entry_id", T.half_even(F.col("hits") / F.col("n_terms"), 4).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "entry_id", "score")


def dangling_postings(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Postings whose entry is no document."""
    return index.join(documents.select("entry_id"), "entry_id", "left_anti")


def missing_postings(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Document terms without a posting."""
    return postings(documents).join(index, ["term", "entry_id"], "left_anti")


def cardinality(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.sum(F.size("terms")).cast("long").alias("postings")).crossJoin(postings(documents).agg(F.countDistinct("term").alias("terms")))


def lexical_view(index: dict) -> tuple[list[dict], list[tuple[str, str]]]:
    """Documents and postings of an index of either version: the older one has them at its root."""
    block = index.get("lexical", index)
    return list(block["documents"].values()), [(term, e) for term, ids in block["postings"].items() for e in ids]
