"""Every registered query of the engine with its SQL counterpart.

The test tables are no file trees, so they are bound to the data model: documents are files with a path made of
lang, source, doc_id and a suffix; pages.url gives remote paths; events are an append log; benchmark texts are a
batch of queries; embeddings are vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..operators import benchmarks, manifest, reports, rules, search, semantic
from ..sources import synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SUFFIXES = (".txt", ".md", ".png", ".zip", ".bin")
ENDING = ".cairn"
PHRASE = "The shore and nothing of that river"
NAME_PHRASE = "de src1 txt"

#: Shared first parts of the SQL counterparts.
BOUND = r"""
b AS (SELECT doc_id, text, lang, source, lang || '/' || source || '/doc-' || printf('%06d', doc_id) ||
      CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.zip' ELSE '.bin' END AS path FROM documents)"""
ENTRIES = (
    BOUND
    + r""",
e AS (SELECT doc_id AS position, printf('e%08d', doc_id) AS entry_id, path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256,
      CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/zip' ELSE 'application/octet-stream' END AS media_type,
      CASE doc_id % 5 WHEN 0 THEN 'zstd' WHEN 1 THEN 'zstd' WHEN 2 THEN 'webp_or_store' ELSE 'store' END AS requested_method,
      CASE WHEN doc_id % 5 < 2 THEN 'deflate' ELSE 'store' END AS codec, doc_id % 5 < 2 AS searchable FROM b)"""
)
LAYOUT = (
    ENTRIES
    + r""",
f AS (SELECT sha256, min(position) AS fp, min(size) AS len FROM e GROUP BY sha256),
o AS (SELECT *, row_number() OVER (ORDER BY fp) - 1 AS ordinal, coalesce(sum(len) OVER (ORDER BY fp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_offset FROM f),
l AS (SELECT e.*, printf('c%08d-', ordinal) || substr(sha256, 1, 16) AS chunk_id, chunk_offset, len AS chunk_length,
      CASE WHEN position <> fp THEN printf('e%08d', fp) END AS dedup_of FROM e JOIN o USING (sha256))"""
)
WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"
DOCS = BOUND + f""",
d AS (SELECT printf('e%08d', doc_id) AS entry_id, path, substr(text, 1, 2048) AS excerpt,
      list_sort(list_distinct(list_concat({WORDS.format("path")}, {WORDS.format("text")}))) AS terms FROM b)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bound(spark: SparkSession, sf: str) -> DataFrame:
    """documents with the path that stands for each."""
    ext = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").withColumn("path", F.concat("lang", F.lit("/"), "source", F.format_string("/doc-%06d", "doc_id"), ext))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return bound(spark, sf).select(F.col("doc_id").alias("position"), "path", F.lit("file").alias("kind"), F.octet_length("text").cast("long").alias("size"), T.sha256(F.col("text")).alias("sha256"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.entries(files(spark, sf))


def layout(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.chunk_layout(entries(spark, sf))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return search.index_documents(bound(spark, sf).select(T.numbered("e", F.col("doc_id")).alias("entry_id"), "path", F.col("text").alias("content")))


# Index and search


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS tokens, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_documents(spark, sf):
    words = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({WORDS.format('text')})), ' ') AS terms FROM documents")
def document_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query(f"WITH {DOCS} SELECT entry_id, path, excerpt, array_to_string(terms, ' ') AS terms FROM d")
def index_documents(spark, sf):
    return documents(spark, sf).withColumn("terms", F.array_join("terms", " "))


@query(f"WITH {DOCS}, p AS (SELECT unnest(terms) AS term, entry_id FROM d) SELECT term, count(*) AS entries, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM p GROUP BY term")
def postings(spark, sf):
    return search.posting_lists(documents(spark, sf))


@query(f"WITH {DOCS} SELECT count(*) AS documents, CAST(sum(len(terms)) AS BIGINT) AS postings, (SELECT count(DISTINCT t) FROM (SELECT unnest(terms) AS t FROM d)) AS terms FROM d")
def index_cardinality(spark, sf):
    return search.cardinality(documents(spark, sf))


def _search_sql(phrase: str, limit: int, all_terms: bool = False) -> str:
    return f"""WITH {DOCS}, q AS (SELECT list_sort(list_distinct({WORDS.format("'" + phrase + "'")})) AS qt),
    m AS (SELECT entry_id, path, excerpt, list_filter(qt, lambda x: list_contains(terms, x)) AS hit, len(qt) AS n FROM d, q)
    SELECT entry_id, path, excerpt, array_to_string(hit, ' ') AS matched_terms, round_even(len(hit) / n, 4) AS score FROM m WHERE len(hit) >= {'n' if all_terms else 1} ORDER BY score DESC, path LIMIT {limit}"""


@query(_search_sql(PHRASE, 20))
def lexical_search_topk(spark, sf):
    return search.search(documents(spark, sf), PHRASE)


@query(_search_sql(PHRASE, 20))
def lexical_search_index(spark, sf):
    docs = documents(spark, sf)
    return search.search_index(search.postings(docs), docs, PHRASE)


@query(_search_sql(NAME_PHRASE, 30))
def search_by_path(spark, sf):
    return search.search(documents(spark, sf), NAME_PHRASE, 30)


@query(_search_sql("the of and src1", 100, True))
def search_all_terms(spark, sf):
    return search.search(documents(spark, sf), "the of and src1", 100, all_terms=True)


@query(
    f"""WITH {DOCS}, q AS (SELECT item_id AS query_id, list_distinct({WORDS.format("text")}) AS qt FROM benchmark),
    h AS (SELECT query_id, len(qt) AS n, unnest(qt) AS term FROM q), p AS (SELECT unnest(terms) AS term, entry_id FROM d),
    s AS (SELECT query_id, entry_id, round_even(count(*) / n, 4) AS score FROM h JOIN p USING (term) GROUP BY query_id, n, entry_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank, entry_id, score FROM s QUALIFY rank <= 5"""
)
def lexical_search_batch(spark, sf):
    return search.search_batch(documents(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query(
    f"""WITH {DOCS}, p AS (SELECT unnest(terms) AS term, entry_id FROM d) SELECT 'dangling' AS problem, count(*) AS postings FROM p WHERE entry_id NOT IN (SELECT printf('e%08d', doc_id) FROM labels)
    UNION ALL SELECT 'missing', count(*) FROM p WHERE entry_id IN (SELECT printf('e%08d', doc_id) FROM documents WHERE doc_id % 7 = 0)"""
)
def postings_integrity(spark, sf):
    """Against an index of the labelled entries only, and one that lacks every seventh entry."""
    docs = documents(spark, sf)
    index = search.postings(docs)
    labelled = table(spark, sf, "labels").select(T.numbered("e", F.col("doc_id")).alias("entry_id"))
    dangling = search.dangling_postings(index, labelled).agg(F.lit("dangling").alias("problem"), F.count("*").alias("postings"))
    partial = index.where(F.substring("entry_id", 2, 20).cast("long") % 7 != 0)
    return dangling.unionByName(search.missing_postings(partial, docs).agg(F.lit("missing").alias("problem"), F.count("*").alias("postings")))


# Policy, entries, layout


@query(f"WITH {ENTRIES} SELECT path, requested_method, codec, searchable, CASE position % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN 'packed' ELSE 'unknown' END AS reason FROM e")
def codec_policy(spark, sf):
    path = F.col("path")
    return bound(spark, sf).select("path", policy.requested_method(path).alias("requested_method"), policy.default_codec(path).alias("codec"), policy.searchable(path).alias("searchable"), policy.policy_reason(path).alias("reason"))


@query(f"WITH {ENTRIES} SELECT media_type, count(*) AS entries FROM e GROUP BY media_type")
def media_type(spark, sf):
    return bound(spark, sf).groupBy(policy.media_type(F.col("path")).alias("media_type")).agg(F.count("*").alias("entries"))


@query(f"WITH {ENTRIES} SELECT * FROM e")
def manifest_entries(spark, sf):
    return entries(spark, sf)


@query(f"WITH {LAYOUT} SELECT entry_id, chunk_id, chunk_offset, chunk_length, dedup_of FROM l")
def dedup_chunks(spark, sf):
    return layout(spark, sf).select("entry_id", "chunk_id", "chunk_offset", "chunk_length", "dedup_of")


@query(
    f"""WITH {ENTRIES} SELECT entry_id, printf('c%08d-', row_number() OVER (ORDER BY position) - 1) || substr(sha256, 1, 16) AS chunk_id,
    coalesce(sum(size) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_offset, size AS chunk_length FROM e"""
)
def chunks_without_dedup(spark, sf):
    return manifest.chunk_layout(entries(spark, sf), dedup=False).select("entry_id", "chunk_id", "chunk_offset", "chunk_length")


@query(
    f"""WITH {LAYOUT} SELECT count(*) AS entries, count(dedup_of) AS dedup_entries, CAST(sum(CASE WHEN dedup_of IS NULL THEN chunk_length ELSE 0 END) AS BIGINT) AS unique_bytes, CAST(sum(size) AS BIGINT) AS raw_bytes,
    count(*) - count(dedup_of) AS unique_entries, round_even(count(dedup_of) / count(*), 6) AS dedup_ratio FROM l"""
)
def dedup_summary(spark, sf):
    return manifest.dedup_summary(layout(spark, sf))


@query(f"WITH {ENTRIES} SELECT k.kind, count(e.kind) AS entries FROM (VALUES ('file'), ('symlink'), ('dir')) k(kind) LEFT JOIN e ON e.kind = k.kind GROUP BY k.kind")
def kind_counts(spark, sf):
    return manifest.kind_counts(entries(spark, sf))


@query(f"WITH {ENTRIES} SELECT codec, count(*) AS entries FROM e GROUP BY codec")
def method_counts(spark, sf):
    return manifest.method_counts(entries(spark, sf))


@query(
    f"""WITH {LAYOUT}, t AS (SELECT count(*) AS entry_count, CAST(sum(size) AS BIGINT) AS raw_bytes, CAST(sum(CASE WHEN dedup_of IS NULL THEN chunk_length ELSE 0 END) AS BIGINT) AS data_length,
    count(*) FILTER (searchable) AS searchable, count(DISTINCT chunk_id) AS chunks FROM l)
    SELECT *, raw_bytes - data_length AS saved_bytes, round_even((raw_bytes - data_length) / raw_bytes * 100, 2) AS saved_pct, 1 AS format_version FROM t"""
)
def manifest_info(spark, sf):
    return manifest.info(layout(spark, sf))


@query(f"WITH {LAYOUT} SELECT entry_id, chunk_offset, chunk_length FROM l WHERE chunk_offset + chunk_length > 1000000")
def chunk_bounds(spark, sf):
    return manifest.out_of_bounds(layout(spark, sf), 1_000_000).select("entry_id", "chunk_offset", "chunk_length")


@query("SELECT * FROM (VALUES ('header', 0::BIGINT, 8197::BIGINT), ('manifest', 8197, 4000), ('index', 12197, 900)) t(section, \"offset\", length)")
def range_plan(spark, sf):
    return manifest.section_ranges(4000, 900, table(spark, sf, "region"))


@query(
    """WITH p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'app/.git/c' || doc_id WHEN 1 THEN 'app/src/m' || doc_id WHEN 2 THEN '/etc/d' || doc_id WHEN 3 THEN 'a/node_modules/b/n' || doc_id WHEN 4 THEN 'link' || doc_id ELSE 'd/x' || doc_id END AS path,
    CASE doc_id % 8 WHEN 4 THEN 'symlink' WHEN 5 THEN 'fifo' ELSE 'file' END AS kind FROM documents),
    r AS (SELECT CASE doc_id % 8 WHEN 0 THEN 'protected' WHEN 3 THEN 'protected' WHEN 2 THEN 'system' WHEN 5 THEN 'special' WHEN 4 THEN CASE WHEN doc_id % 16 = 4 THEN 'symlink-target' END END AS reason FROM p)
    SELECT coalesce(reason, 'total') AS reason, count(*) AS paths FROM r WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)"""
)
def skip_summary(spark, sf):
    i = F.col("doc_id")
    path = F.when(i % 8 == 0, F.concat(F.lit("app/.git/c"), i)).when(i % 8 == 1, F.concat(F.lit("app/src/m"), i)).when(i % 8 == 2, F.concat(F.lit("/etc/d"), i)).when(i % 8 == 3, F.concat(F.lit("a/node_modules/b/n"), i)).when(i % 8 == 4, F.concat(F.lit("link"), i)).otherwise(F.concat(F.lit("d/x"), i))
    rows = table(spark, sf, "documents").select(path.alias("path"), F.when(i % 8 == 4, "symlink").when(i % 8 == 5, "fifo").otherwise("file").alias("kind"), F.when(i % 16 == 4, F.lit("")).otherwise(F.lit("t")).alias("target"))
    reason = policy.skip_reason(F.col("path"), F.col("kind"), F.col("target"))
    return reports.skip_summary(rows.select(reason.alias("reason")).where("reason IS NOT NULL"))


@query(
    """WITH p AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'p' || doc_id % 40 || '/.git' WHEN 1 THEN 'p' || doc_id % 40 || '/.git/objects/o' || doc_id WHEN 2 THEN 'p' || doc_id % 40 || '/src/f' || doc_id ELSE 'venv/v' || doc_id END AS path FROM documents)
    SELECT path, CASE WHEN path LIKE '%/.git' THEN 'protected' ELSE 'kept' END AS verdict FROM p WHERE path LIKE '%/.git' OR path LIKE '%/src/%'"""
)
def protected_prune(spark, sf):
    i = F.col("doc_id")
    p = F.concat(F.lit("p"), i % 40)
    path = F.when(i % 4 == 0, F.concat(p, F.lit("/.git"))).when(i % 4 == 1, F.concat(p, F.lit("/.git/objects/o"), i)).when(i % 4 == 2, F.concat(p, F.lit("/src/f"), i)).otherwise(F.concat(F.lit("venv/v"), i))
    return manifest.protected_prune(table(spark, sf, "documents").select(path.alias("path")))


# Rules


@query(r"SELECT page_id, coalesce(trim(p) <> '' AND NOT contains(p, '\') AND NOT regexp_matches(p, '^.:') AND NOT regexp_matches(p, '(^|/)(\.{1,2})?(/|$)'), false) AS ok FROM (SELECT page_id, substr(url, instr(url, '://') + 3) AS p FROM pages)")
def path_violations(spark, sf):
    url = F.substring("url", F.instr("url", "://") + 3, F.length("url"))
    return rules.path_violations(table(spark, sf, "pages"), "page_id", url)


@query(
    r"""SELECT page_id, NOT contains(p, '\') AND NOT regexp_matches(p, '(^|/)(\.{1,2})?(/|$)') AND NOT contains(p, ':') AS ok
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'a/../' || page_id ELSE replace(replace(url, '://', '/'), '//', '/') END || '.CAIRN' AS p FROM pages)"""
)
def remote_path_violations(spark, sf):
    i = F.col("page_id")
    path = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("a/../"), i)).otherwise(F.replace(F.replace("url", F.lit("://"), F.lit("/")), F.lit("//"), F.lit("/")))
    return rules.path_violations(table(spark, sf, "pages").select("page_id", F.concat(path, F.lit(".CAIRN")).alias("p")), "page_id", F.col("p"), ENDING)


def defective(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue with one defect in each of several residue classes."""
    i = F.col("position")
    return layout(spark, sf).select(
        "position", F.when(i % 31 == 1, "").otherwise(F.col("entry_id")).alias("entry_id"), F.when(i % 31 == 2, F.concat(F.lit("../"), "path")).when(i % 31 == 3, "same/path").otherwise(F.col("path")).alias("path"),
        F.when(i % 31 == 4, "socket").when(i % 31 == 5, "symlink").otherwise(F.col("kind")).alias("kind"), F.when(i % 31 == 6, 4096).otherwise(420).alias("mode"), F.when(i % 31 == 7, -1).otherwise(1).cast("long").alias("mtime_ns"),
        F.when(i % 31 == 8, "t").alias("target"), F.when(i % 31 == 9, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"), F.when(i % 31 == 10, " ").otherwise(F.col("chunk_id")).alias("chunk_id"), "size", "chunk_offset", "chunk_length",
        F.when(i % 31 == 11, F.col("chunk_length") + 1).otherwise(F.col("chunk_length")).alias("stored_size"), F.when(i % 31 == 12, "lzma").otherwise(F.col("codec")).alias("codec"), F.when(i % 31 == 13, F.lit(None)).otherwise(F.col("searchable")).alias("searchable"),
    )


@query(
    """WITH d AS (SELECT doc_id AS position, doc_id % 31 AS m, sha256(text) AS sha FROM documents),
    r AS (SELECT position, CASE m WHEN 1 THEN 'entry-id' WHEN 2 THEN 'path' WHEN 4 THEN 'kind' WHEN 5 THEN 'target-missing' WHEN 6 THEN 'mode' WHEN 7 THEN 'mtime' WHEN 8 THEN 'target-unexpected'
    WHEN 9 THEN 'sha256' WHEN 10 THEN 'chunk-id' WHEN 11 THEN 'stored-size' WHEN 12 THEN 'codec' WHEN 13 THEN 'searchable' END AS rule FROM d)
    SELECT position, rule FROM r WHERE rule IS NOT NULL
    UNION ALL SELECT position, 'duplicate-path' FROM d WHERE m = 3 AND position > (SELECT min(position) FROM d WHERE m = 3)
    UNION ALL SELECT position, 'duplicate-entry-id' FROM d WHERE m = 1 AND position > (SELECT min(position) FROM d WHERE m = 1)"""
)
def manifest_violations(spark, sf):
    return rules.manifest_violations(defective(spark, sf))


@query(
    """WITH p AS (SELECT doc_id, 'd' || doc_id % 20 || '/' || CASE WHEN doc_id % 3 = 0 THEN 'sub/' ELSE '' END || 'f' || doc_id AS path FROM documents)
    SELECT path FROM p WHERE path LIKE 'd1/%' OR path LIKE 'd7/sub/%' OR path LIKE 'd12/%'"""
)
def write_through_link(spark, sf):
    i = F.col("doc_id")
    paths = table(spark, sf, "documents").select(F.concat(F.lit("d"), i % 20, F.lit("/"), F.when(i % 3 == 0, "sub/").otherwise(""), F.lit("f"), i).alias("path"))
    links = spark.createDataFrame([("d1",), ("d7/sub",), ("d12",)], "prefix string")
    return manifest.below(paths, links, "left_semi")


@query(
    """SELECT printf('e%08d', l.doc_id) AS entry_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'path' END AS problem
    FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 100000000 FROM labels WHERE doc_id % 10 = 1) l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id % 10 = 2"""
)
def alignment_orphans(spark, sf):
    """Index documents of the labelled entries: some with another path, some with ids that no entry has."""
    i = F.col("doc_id")
    own = table(spark, sf, "labels").select("doc_id")
    ids = own.unionByName(own.where(i % 10 == 1).select((i + 100_000_000).alias("doc_id")))
    named = ids.join(bound(spark, sf).select("doc_id", "path"), "doc_id", "left")
    docs = named.select(T.numbered("e", i).alias("entry_id"), F.when(i % 10 == 2, F.concat("path", F.lit("~"))).otherwise(F.coalesce("path", F.lit("gone"))).alias("path"))
    return manifest.alignment(entries(spark, sf), docs)


@query(
    f"""WITH {ENTRIES}, x AS (SELECT entry_id, sha256 FROM e), y AS (SELECT entry_id, CASE WHEN position % 11 = 3 THEN upper(sha256) ELSE sha256 END AS sha256 FROM e WHERE position % 13 <> 5)
    SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'right' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)"""
)
def sidecar_diff(spark, sf):
    rows = entries(spark, sf)
    copy = rows.where("position % 13 <> 5").select("entry_id", F.when(F.col("position") % 11 == 3, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return manifest.difference(rows.select("entry_id", "sha256"), copy)


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("position")
    rows = entries(spark, sf).where(i % 17 != 4)
    rows = rows.withColumns({"size": F.when(i % 17 == 5, F.col("size") + 1).otherwise(F.col("size")), "sha256": F.when(i % 17 == 6, F.reverse("sha256")).otherwise(F.col("sha256")), "kind": F.when(i % 17 == 7, "dir").otherwise(F.col("kind"))})
    return rows.unionByName(rows.where(i % 17 == 8).withColumn("path", F.concat("path", F.lit(".extra"))))


RESTORED = "CASE position % 17 WHEN 4 THEN 'missing' WHEN 5 THEN 'size' WHEN 6 THEN 'content' WHEN 7 THEN 'kind' END"


@query(f"WITH {ENTRIES} SELECT path, {RESTORED} AS problem FROM e WHERE position % 17 IN (4, 5, 6, 7) UNION ALL SELECT path || '.extra', 'extra' FROM e WHERE position % 17 = 8")
def restore_diff(spark, sf):
    return manifest.restore_check(entries(spark, sf), _restored(spark, sf))


@query(
    f"""WITH {ENTRIES}, r AS (SELECT path, {RESTORED} AS problem FROM e WHERE position % 17 IN (4, 5, 6, 7) UNION ALL SELECT path || '.extra', 'extra' FROM e WHERE position % 17 = 8)
    SELECT problem, count(*) AS paths, array_to_string(list_slice(list_sort(list(path)), 1, 20), ',') AS first_paths FROM r GROUP BY problem"""
)
def restore_verdict(spark, sf):
    return manifest.restore_verdict(manifest.restore_check(entries(spark, sf), _restored(spark, sf)))


# Stores, remote reads, logs


@query("SELECT DISTINCT split_part(p, '/', 1) AS name, count(*) AS objects FROM (SELECT substr(url, instr(url, '://') + 3) AS p FROM pages) GROUP BY 1")
def list_folder(spark, sf):
    paths = table(spark, sf, "pages").select(F.substring("url", F.instr("url", "://") + 3, F.length("url")).alias("p"))
    return paths.groupBy(F.element_at(F.split("p", "/"), 1).alias("name")).agg(F.count("*").alias("objects"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[1-3].*\.h.ml$')")
def find_glob(spark, sf):
    return table(spark, sf, "pages").where(T.base_name(F.col("url")).rlike(T.glob_regex("[1-3]*.h?ml"))).select("page_id", "url")


@query("SELECT * FROM (VALUES (2, 'reads'), (3, 'data-section'), (4, 'bytes'), (4, 'reads')) t(run, rule)")
def telemetry_check(spark, sf):
    rows = spark.createDataFrame([(1, 3, 0, 9000, False), (2, 2, 0, 9000, False), (3, 0, 2, 50, True), (4, 3, 2, 0, False)], "run int, range_reads int, sidecar_reads int, bytes_read long, data_section_read boolean")
    return rules.violations(rows, "run", rules.telemetry_rules())


@query("SELECT * FROM (VALUES (2, 'ready-model'), (2, 'ready-ref'), (3, 'metric'), (4, 'unavailable-ref'), (5, 'ready-dimensions')) t(id, rule)")
def descriptor_check(spark, sf):
    rows = [(1, "ready", "m", 64, "cosine", "native"), (2, "ready", " ", 64, "l2", "none"), (3, "unavailable", None, None, "angle", "none"), (4, "unavailable", None, None, "dot", "sidecar"), (5, "ready", "m", None, "dot", "external")]
    return rules.violations(spark.createDataFrame(rows, "id int, status string, model_id string, dimensions int, metric string, index_ref string"), "id", rules.descriptor_rules())


@query("SELECT count(*) AS records, CAST(sum(n_chars) AS BIGINT) AS raw_bytes, CAST(sum(CASE WHEN doc_id % 3 > 0 THEN n_chars // 2 ELSE 0 END) AS BIGINT) AS packed_bytes, CAST(sum(n_chars) - sum(CASE WHEN doc_id % 3 > 0 THEN n_chars // 2 ELSE 0 END) AS BIGINT) AS saved_bytes FROM documents")
def savings_summary(spark, sf):
    i = F.col("doc_id")
    return reports.savings_summary(table(spark, sf, "documents").select(F.col("n_chars").alias("raw_bytes"), F.when(i % 3 > 0, F.floor(F.col("n_chars") / 2)).alias("packed_bytes")))


@query("SELECT event_id, 1::BIGINT AS schema_version, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type AS operation, json_extract_string(props, '$.k') AS detail FROM events")
def action_log_redact(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("operation"), F.get_json_object("props", "$.k").alias("detail"), F.col("user_id").alias("secret_user"))
    return reports.redact(rows, (*reports.ACTION_FIELDS, "event_id"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def log_by_day(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("events"), F.bround(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, path FROM (SELECT event_id, 'root/p' || user_id % 3 || '/' || printf('%02d', CAST(event_id % 12 AS INT)) || CASE WHEN event_id % 2 = 0 THEN '' ELSE '/x' END AS path FROM events) WHERE path = 'root/p1/07' OR path LIKE 'root/p1/07/%'")
def weekly_folder(spark, sf):
    i = F.col("event_id")
    path = F.concat(F.lit("root/p"), F.col("user_id") % 3, F.lit("/"), F.format_string("%02d", i % 12), F.when(i % 2 == 0, "").otherwise("/x"))
    return reports.within_week(table(spark, sf, "events").select("event_id", path.alias("path")), "path", "root", "p1", 7)


@query(
    """SELECT order_id, raw_bytes, packed_bytes, raw_bytes - packed_bytes AS saved_bytes, printf('grew by %d bytes (%.2f%%)', packed_bytes - raw_bytes, -round_even((raw_bytes - packed_bytes) / raw_bytes * 100, 2)) AS warning
    FROM (SELECT o_orderkey AS order_id, CAST(1000 + o_orderkey % 97 AS BIGINT) AS raw_bytes, CAST(1000 + o_custkey % 101 AS BIGINT) AS packed_bytes FROM orders) WHERE raw_bytes < packed_bytes"""
)
def negative_savings(spark, sf):
    return reports.negative_savings(table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 97 + 1000).alias("raw_bytes"), (F.col("o_custkey") % 101 + 1000).alias("packed_bytes")))


# Figures of benchmark runs.  Fixed values: published sizes, seconds, peaks and staging of six runs.
RUNS = [("pack", 1 << 30, 33.496, 27_230_208, 1_075_384_320), ("pack", 5 << 30, 183.054, 27_013_120, 5_376_921_600), ("pack", 10 << 30, 488.938, 27_136_000, 10_753_843_200), ("unpack", 1 << 30, 1.421, 31_145_984, 1 << 30), ("unpack", 5 << 30, 75.702, 32_530_432, 5 << 30), ("unpack", 10 << 30, 494.14, 32_673_792, 10 << 30)]
RUN_ROWS = ", ".join(f"('{o}', {n}::BIGINT, {s}::DOUBLE, {r}::BIGINT, {t}::BIGINT)" for o, n, s, r, t in RUNS)
RUN_SQL = f"r AS (SELECT * FROM (VALUES {RUN_ROWS}) t(operation, size_bytes, seconds, peak_rss_bytes, temp_bytes))"


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "operation string, size_bytes long, seconds double, peak_rss_bytes long, temp_bytes long")


@query(
    f"""WITH {RUN_SQL}, l AS (SELECT *, CAST(floor(size_bytes * CASE operation WHEN 'pack' THEN 2.1::DOUBLE ELSE 1.1::DOUBLE END + 67108864.0) AS BIGINT) AS temp_limit FROM r)
    SELECT *, peak_rss_bytes <= 268435456 AS rss_ok, temp_bytes <= temp_limit AS temp_ok, peak_rss_bytes <= 268435456 AND temp_bytes <= temp_limit AS passed FROM l"""
)
def slo_evaluation(spark, sf):
    return reports.slo(runs(spark), 256 * reports.MIB, 2.1, 1.1, 64 * reports.MIB)


@query(f"WITH {RUN_SQL} SELECT operation, max(peak_rss_bytes) - min(peak_rss_bytes) AS spread_bytes, count(*) AS runs, max(peak_rss_bytes) - min(peak_rss_bytes) <= 67108864 AS within FROM r GROUP BY operation")
def rss_spread(spark, sf):
    return reports.spread(runs(spark), 64 * reports.MIB)


@query(f"WITH {RUN_SQL} SELECT *, round_even(size_bytes / 1048576 / seconds, 3) AS mib_per_second, round_even(temp_bytes / size_bytes, 6) AS temp_ratio FROM r")
def throughput(spark, sf):
    return reports.throughput(runs(spark))


@query(f"WITH {RUN_SQL} SELECT w.size_bytes FROM (VALUES (1073741824::BIGINT), (21474836480)) w(size_bytes) WHERE w.size_bytes NOT IN (SELECT size_bytes FROM r)")
def missing_sizes(spark, sf):
    return reports.missing(spark.createDataFrame([(1 << 30,), (20 << 30,)], "size_bytes long"), runs(spark), "size_bytes")


@query(
    """WITH f AS (SELECT range AS position, printf('group-%04d/file-%08d.txt', range % 32, range) AS path,
    left(repeat(CASE WHEN range % 32 = 0 THEN 'group zero ' ELSE printf('group %d file %d ', range % 32, range) END, 512), 512) AS content FROM range(512))
    SELECT count(*) AS files, count(DISTINCT content) AS unique_files, count(*) - count(DISTINCT content) AS dedup_files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM f"""
)
def synthetic_groups(spark, sf):
    rows = synthetic.files(spark, 512, 512, 32)
    out = rows.agg(F.count("*").alias("files"), F.countDistinct(F.sha2("content", 256)).alias("unique_files"), F.sum(F.octet_length("content")).alias("bytes"))
    return out.withColumn("dedup_files", F.col("files") - F.col("unique_files"))


@query("SELECT count(*) AS blocks, 10000001::BIGINT AS bytes FROM range(153)")
def synthetic_blocks(spark, sf):
    return synthetic.blocks(spark, 10_000_001).agg(F.count("*").alias("blocks"), F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT * FROM (VALUES (2, 'entries'), (2, 'ratio'), (3, 'dedup'), (3, 'ratio'), (4, 'documents')) t(run, rule)")
def artifact_check(spark, sf):
    names = "run int, files long, dirs long, links long, entries long, index_documents long, dedup_entries long, unique_entries long, dedup_ratio double"
    rows = [(1, 512, 0, 0, 512, 512, 15, 497, 0.029297), (2, 512, 32, 0, 512, 512, 15, 497, 0.03), (3, 10, 0, 0, 10, 10, 1, 8, 0.2), (4, 10, 0, 0, 10, 11, 1, 9, 0.1)]
    return rules.violations(spark.createDataFrame(rows, names), "run", benchmarks.artifact_rules())


# Modes and vectors


@query("SELECT * FROM (VALUES ('lexical', 'lexical', NULL), ('missing', 'lexical', 'backend-missing'), ('failing', 'lexical', 'backend-failed: ValueError'), ('old', 'lexical', 'backend-api-version'), ('wrong', 'lexical', 'backend-wrong-entry'), ('good', 'semantic', NULL)) t(\"case\", mode_used, reason)")
def mode_fallback(spark, sf):
    docs = documents(spark, sf)
    one = docs.orderBy("entry_id").select("entry_id", "path").first().asDict()

    def fails(**_):
        raise ValueError("no")

    cases = {
        "lexical": ("lexical", None), "missing": ("semantic", None), "failing": ("semantic", semantic.Backend(fails)), "old": ("semantic", semantic.Backend(fails, api_version="0")),
        "wrong": ("semantic", semantic.Backend(lambda **_: [one | {"path": "other"}])), "good": ("semantic", semantic.Backend(lambda **_: [one | {"score": 1}])),
    }
    found = [(name, (a := semantic.answer(docs, PHRASE, mode=mode, backend=backend)).mode_used, a.fallback_reason) for name, (mode, backend) in cases.items()]
    return spark.createDataFrame(found, "case string, mode_used string, reason string")


PROBE = [((k * 37) % 19 - 9) / 10 for k in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


def _vectors(metric: str) -> Query:
    def run(spark, sf):
        return semantic.vector_topk(table(spark, sf, "embeddings"), PROBE, metric)

    run.__name__ = f"vector_topk_{metric}"
    return run


for _metric, _expression in {"cosine": "list_cosine_similarity(v, p)", "dot": "list_dot_product(v, p)", "l2": "-list_distance(v, p)"}.items():
    query(f"SELECT vec_id, round_even({_expression}, 4) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v, {PROBE_SQL} AS p FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10")(_vectors(_metric))


# Extensions: grouping sets over documents


@query("SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (lang, source)")
def documents_cube(spark, sf):
    return table(spark, sf, "documents").cube("lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
