import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import exact_dedup as ed

LOW = {c: c + 32 for c in range(65, 91)}


def brute_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(LOW)
        ids = [x for x in groups[text] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[text]), i is not None and i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "A", "a", "É", "é", "x" * 50_000, "X" * 50_000, *(f"text {rng.randrange(40)}" for _ in range(150)), *["hot"] * 80]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)] + [(None, "A"), (None, "alone"), (3, texts[3])]


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("hot_share", [0.001, 0.2])
def test_matches_brute_force(spark, digest_bytes, hot_share):
    """With digests of one byte many texts collide, and still never merge."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"digest": F.lit(1), "norm": F.lit("clash"), "salt": F.lit(0)}).repartition(5)
    out = ed.exact_dedup(docs, digest_bytes=digest_bytes, hot_share=hot_share, salts=4)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_force(rows())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_dedup(docs).count() == 0 and ed.keep_one(docs).count() == 0


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (3, "b", "z"), (3, "b", "z"), (None, "a", "n"), (None, "q", "n"), (None, "Q", "n")], "doc_id long, text string, cairn string")
    out = ed.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in out.collect()) == [(0, "q"), (2, "a"), (3, "b")]


def test_sql(spark):
    want = duckdb.sql(ed.ORACLE.replace("FROM documents", "FROM '/root/testdata/sf0.001/documents.parquet'")).fetchall()
    got = ed.exact_dedup(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
