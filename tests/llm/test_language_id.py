import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import language_id as li


def test_automaton_knows_exactly_the_substrings():
    rng = random.Random(1)
    for _ in range(40):
        text = [rng.randrange(3) for _ in range(rng.randint(0, 25))]
        edges = li.suffix_automaton(text)
        inside = {()} | {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        for n in range(5):
            for word in np.ndindex(*[3] * n):
                state = 0
                for c in word:
                    state = edges[state].get(c, -1) if state >= 0 else -1
                assert (state >= 0) == (word in inside)
        assert len(edges) <= max(1, 2 * len(text))


def brute_phrases(sample, text):
    """Greedy longest-match phrases of a text over a sample, both as folded strings."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at += max(1, n - 1)
        count += 1
    return count


def test_phrases_match_brute_force():
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    samples = {"x": " ".join(word("abcd") for _ in range(60)), "y": " ".join(word("cdef") for _ in range(60))}
    parser = li.CrossParser(samples)
    texts = [" ".join(word("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(20)] + ["A!!B..c  D", "q"]
    total, size, _ = parser.phrases(texts)
    for t, row, n in zip(texts, total, size, strict=True):
        folded = "".join(chr(c) if c else " " for c in li.folded(t))
        assert n == len(folded)
        assert row.tolist() == [brute_phrases("".join(chr(c) if c else " " for c in li.folded(samples[k])), folded) for k in ("x", "y")]


def test_long_texts_are_parsed_in_one_go(monkeypatch):
    """Texts of many segments have the phrases of one parse, whether or not segments meet, with dense and listed letters."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    samples = {k: " ".join(word(letters) for _ in range(80)) for k, letters in (("x", "abcd"), ("y", "cdef"), ("z", "".join(chr(0x4E00 + k) for k in range(120))))}
    whole = " ".join(word("abc") for _ in range(300))
    samples["w"] = whole
    texts = [" ".join(word("abcdefg" + chr(0x4E00 + rng.randrange(130))) for _ in range(rng.randint(1, 1500))) for _ in range(12)] + [whole[5:], "", "a" * 5000, whole * 3]
    for segment, meet, dense in ((1024, 192, 96), (64, 16, 4), (50, 3, 0), (200, 200, 2)):
        monkeypatch.setattr(li, "SEGMENT", segment)
        monkeypatch.setattr(li, "MEET", meet)
        total, size, _ = li.CrossParser(samples, dense).phrases(texts)
        folds = lambda t: "".join(chr(c) if c else " " for c in li.folded(t))
        assert size.tolist() == [len(folds(t)) for t in texts]
        for t, row in zip(texts, total, strict=True):
            assert row.tolist() == [brute_phrases(folds(samples[k]), folds(t)) for k in sorted(samples)]


def test_scripts_of_many_letters():
    """Two languages of 3,000 letters each, none in common, are told apart."""
    rng = random.Random(4)
    text = lambda first, n: " ".join("".join(chr(first + int(3000 * rng.random() ** 2)) for _ in range(3)) for _ in range(n))
    parser = li.CrossParser({"a": text(0x4E00, 5000), "b": text(0x6000, 5000), "en": "the river and the stone " * 50})
    assert parser.predict([text(0x4E00, 40), text(0x6000, 40), "a stone in the river"])[0] == ["a", "b", "en"]


def test_clashing_columns_and_ties(spark):
    docs = spark.createDataFrame([(k, "one two three", "xx" if k % 2 else "yy", "mine", 5) for k in range(9)] + [(9, "!!", "xx", "mine", 5)], "doc_id long, text string, lang string, cairn_lang string, CAIRN_SCORE int")
    out = li.keep_known(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] != 9)
    same = li.CrossParser({"b": "abc abd", "a": "abc abd"})
    assert same.predict(["abd abc"])[0] == ["a"]


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5 values"):
        li.language_id(docs, buckets=1, most_languages=5).count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_of_the_row_but_its_text_is_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    hidden = docs.withColumn("lang", F.when(~held, F.col("lang")))
    assert sorted(li.language_id(docs).collect()) == sorted(li.language_id(hidden).collect())


def test_edges(spark):
    rows = [(k, "the of and that is " * 5, "en") for k in range(12)] + [(20, None, "en"), (21, "123 !?", None), (22, "", "zz"), (None, "the and", "en"), (1, "the of and that is " * 5, "en"), (23, "x" * 300_000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r["doc_id"]: r for r in li.language_id(docs).collect()}
    assert [out[k]["lang_pred"] for k in (20, 21, 22)] == ["und"] * 3 and out[23]["lang_pred"] == "en" and not out[None]["held_out"]
    assert li.language_id(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in li.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
