import re

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import text as T
from cairnspark.operators import search, semantic


def model(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


TEXTS = ["Привет мир streamingNeedle", "a_b ² ¼ x², naïve CAFÉ", "漢字 かな mixed123", "", "ΟΔΟΣ end", "tail " * 50 + "needle-at-the-end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"e{k:08d}", f"dir/file-{k}.txt", t) for k, t in enumerate(TEXTS)]
    return search.index_documents(spark.createDataFrame(rows, "entry_id string, path string, content string"))


def test_tokens_follow_the_model(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(T.tokens(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [model(t) for t in TEXTS]


def test_path_words_are_indexed(docs):
    assert {r["path"] for r in search.search(docs, "file 3").collect()} >= {"dir/file-3.txt"}
    assert search.search(docs, "file 3").first()["path"] == "dir/file-3.txt"


def test_scan_and_index_agree(docs):
    index = search.postings(docs)
    for query in ("needle end tail", "мир café", "x b nothing", "file"):
        assert search.search(docs, query).collect() == search.search_index(index, docs, query).collect()


def test_score_is_rounded_half_to_even(spark):
    words = [f"w{k}" for k in range(32)]
    docs = search.index_documents(spark.createDataFrame([("e0", "p", "w0"), ("e1", "q", "w0 w1 w2")], "entry_id string, path string, content string"))
    assert [r["score"] for r in search.search(docs, " ".join(words)).collect()] == [round(3 / 32, 4), round(1 / 32, 4)]


def test_empty_query_bad_limits_and_all_terms(docs):
    assert search.search(docs, " ... ").count() == 0
    for limit in (0, 101, True, "5"):
        with pytest.raises(search.SearchError):
            search.search(docs, "x", limit)
    with pytest.raises(search.SearchError):
        search.search(docs, None)
    assert [r["path"] for r in search.search(docs, "needle end", all_terms=True).collect()] == ["dir/file-5.txt"]


def test_batch_and_integrity(spark, docs):
    asked = spark.createDataFrame([(1, "needle end"), (2, "nothing here"), (3, None)], "query_id int, query string")
    out = search.search_batch(docs, asked, 2).collect()
    assert [(r["query_id"], r["rank"], r["score"]) for r in sorted(out)][0] == (1, 1, 1.0)
    index = search.postings(docs)
    assert search.dangling_postings(index, docs).count() == search.missing_postings(index, docs).count() == 0
    assert search.missing_postings(index.where("entry_id <> 'e00000000'"), docs).select("entry_id").distinct().count() == 1


def test_partitions_change_nothing(docs):
    assert search.search(docs.repartition(7), "end tail мир").collect() == search.search(docs.coalesce(1), "end tail мир").collect()


def test_modes_fall_back_and_say_why(docs):
    entry = docs.first()
    row = {"entry_id": entry["entry_id"], "path": entry["path"]}
    good = semantic.answer(docs, "x", mode="semantic", backend=semantic.Backend(lambda query, archive, limit: [row]))
    assert (good.mode_used, good.results.count(), good.results.first()["score"]) == ("semantic", 1, 0.0)
    positional = semantic.answer(docs, "x", mode="semantic", backend=semantic.Backend(lambda q, a, n, /: [row]))
    assert positional.mode_used == "semantic"
    cases = [(None, "backend-missing"), (semantic.Backend(None), "backend-function-missing"), (semantic.Backend(len, supported=False), "backend-not-supported"), (semantic.Backend(len, index_version=1), "backend-index-version"), (semantic.Backend(lambda **_: [row | {"entry_id": "no"}]), "backend-wrong-entry")]
    for backend, reason in cases:
        out = semantic.answer(docs, "needle", mode="semantic", backend=backend)
        assert (out.mode_used, out.fallback_reason) == ("lexical", reason)
        assert out.results.count() == 1
    with pytest.raises(semantic.MismatchError):
        semantic.answer(docs, "x", mode="semantic", backend=cases[-1][0], remote=True)
    with pytest.raises(search.SearchError):
        semantic.answer(docs, "x", mode="other")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "vec_id int, embedding array<float>")
    top = lambda metric: [(r[0], r[1]) for r in semantic.vector_topk(df, [1.0, 0.0], metric, 3).collect()]
    assert top("cosine") == [(1, 1.0), (2, 0.6), (3, 0.0)]
    assert top("l2") == [(1, 0.0), (2, -0.8944), (3, -1.0)]
    with pytest.raises(search.SearchError):
        semantic.vector_topk(df, [1.0], "hamming")


def test_versions_of_an_index():
    block = {"documents": {"e1": {"entry_id": "e1", "path": "p"}}, "postings": {"x": ["e1"]}}
    assert search.lexical_view(block) == search.lexical_view({"lexical": block}) == ([{"entry_id": "e1", "path": "p"}], [("x", "e1")])
