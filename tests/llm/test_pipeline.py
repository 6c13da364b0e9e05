import random

import corpus_pipeline
import pytest

from cairnspark.llm import decontaminate, packing
from cairnspark.llm import queries as llm
from tests.llm.test_exact_dedup import LOW
from tests.llm.test_jaccard_join import brute_force as near
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_do_what_brute_force_does(spark, tmp_path):
    rng = random.Random(1)
    english = ["the", "river", "of", "and", "shore", "thing", "water", "is", "under", "stone", "with", "green"]
    sentence = lambda n: " ".join(rng.choice(english) + rng.choice(["", "s", "ing"]) for _ in range(n))
    item = sentence(25)
    rows = [(k, sentence(rng.randint(30, 60))) for k in range(40)]
    rows += [(100 + k, t.upper()) for k, t in rows[:6]]  # copies
    rows += [(200 + k, t + " extra word") for k, t in rows[6:12]]  # near copies
    rows += [(300 + k, f"{t} {item}") for k, t in rows[12:16]]  # contaminated
    rows += [(400, None), (401, "12 34"), (402, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in kept:
        last[t.translate(LOW)] = max(i, last.get(t.translate(LOW), i))
    kept = [(i, t) for i, t in kept if last[t.translate(LOW)] == i]
    component = {i: c for i, _, c in near(kept)}
    kept = [(i, t) for i, t in kept if component[i] == i]
    kept = [(i, t) for i, t in kept if not decontaminate.brute_force(t, [("i", item)])[1]]
    assert len(kept) == 40

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", *(n for n, _ in packing.FIELDS)]
    check(out.collect(), dict(kept))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_every_query_returns_a_row_for_each_row(spark, name):
    out = llm.queries()[name](spark, SF)
    table, key = ("pages", "page_id") if name.startswith("op2_") else ("documents", "doc_id")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert out.select(key).distinct().count() == rows
    assert name.startswith("op5_") or out.count() == rows
