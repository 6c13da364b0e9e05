import random

import duckdb

from cairnspark.llm import decontaminate as dc


def fixture(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "x1"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", sentence(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for k in range(12)] + [("long", sentence(60)), ("i3", sentence(12)), ("none", None)]
    docs = [(k, sentence(rng.randint(0, 40))) for k in range(40)]
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
        docs.append((100 + k, f"{sentence(7)}. {'--'.join(w[a:b]).upper()}; {sentence(5)}"))
        docs.append((200 + k, f"{sentence(3)} {text} {sentence(4)} {text}"))
    return docs + [(300, None), (301, ""), (302, "..."), (303, dict(items)["long"] + " " + sentence(20_000))], items


def small(items):
    """Items of fewer than three common words would hit nearly everything, which tests little."""
    return [(n, t) for n, t in items if t is None or len(t.split()) != 1]


def test_matches_brute_force(spark):
    docs, items = fixture()
    for some in (items, small(items), [], [("e", "")]):
        benchmark = spark.createDataFrame(some, "item_id string, text string")
        df = spark.createDataFrame([(*d, "clash") for d in docs if d[0] != 303], "doc_id long, text string, n_words string").repartition(3)
        out = dc.decontamination_report(df, benchmark)
        assert out.columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        got = {r["doc_id"]: tuple(r)[1:6] for r in out.collect()}
        for k, text in docs:
            if k != 303:
                want = dc.brute_force(text, some)
                assert got[k] == (*want, want[1] > 0), (k, text)


def test_longest_match_and_its_place(spark):
    """With blocks of 7 words items are cut, passes are chained, and the report stays the same."""
    docs, items = fixture(2)
    docs = [d for d in docs if d[0] != 303] + [(303, dict(items)["long"] + " " + " ".join(f"u{k}" for k in range(20_000))), (304, "w3 nothing else"), (305, "nothing at all")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(small(items), "item_id string, text string")
    one = {r["doc_id"]: r for r in dc.decontamination_report(df, benchmark).collect()}
    many = {r["doc_id"]: r for r in dc.decontamination_report(df, benchmark, block_words=60).collect()}
    texts = {}
    for name, text in small(items):
        texts.setdefault(name, []).append(dc.words(text))
    for k, text in docs:
        assert one[k][:6] == many[k][:6]
        for r in (one[k],) if k == 303 else (one[k], many[k]):
            want = 60 if k == 303 else dc.longest_match(text, small(items))
            assert r["longest"] == want or (r is many[k] and want > dc.WINDOW)  # a long match is given up to the end of its block
            if r["longest"]:
                piece = dc.words(text)[r["longest_at"] : r["longest_at"] + r["longest"]]
                assert any(w[r["longest_item_at"] : r["longest_item_at"] + r["longest"]] == piece for w in texts[r["longest_item"]])
    assert one[305]["longest_item"] is None and one[304]["longest"] == 1


def test_more_distinct_words_than_a_block_holds():
    words = [b"v%d" % k for k in range(2500)]
    parts = list(dc.parts_of("i", words, 1000))
    assert [(p.first, p.count, len(p.words)) for p in parts] == [(0, 1000, 1009), (1000, 1000, 1009), (2000, 500, 500)]
    assert sum(len(dc.TestSuffixes.of([p]).low) for p in parts) == 2491


def test_sql(spark):
    sql = dc.ORACLE
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {name}", f"FROM '/root/testdata/sf0.001/{name}.parquet'")
    at = "/root/testdata/sf0.001"
    out = dc.decontamination_report(*(spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "benchmark"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, out)) == sorted(duckdb.sql(sql).fetchall())


def test_clashing_columns(spark):
    names = [*dc.ADDED, "s", "words"]
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", *range(6)), (2, "clean", *range(6))], ["doc_id", "text", *names])
    out = dc.decontaminate(df, spark.createDataFrame([("x", "a b c d e f g h i j")], "item_id string, text string"))
    assert [tuple(r) for r in out.collect()] == [(2, "clean", *range(6))] and out.columns == df.columns


def test_removal_keeps_clean_rows_and_columns(spark):
    docs, items = fixture(3)
    some = small(items)
    df = spark.createDataFrame([(*d, d[0]) for d in docs if d[0] != 303], "doc_id long, text string, extra long")
    out = dc.decontaminate(df, spark.createDataFrame(some, "item_id string, text string"))
    assert out.columns == df.columns
    assert {r["extra"] for r in out.collect()} == {k for k, t in docs if k != 303 and not dc.brute_force(t, some)[1]}


def test_nulls_repeats_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    benchmark = spark.createDataFrame([(None, text), ("x", text), ("x", text)], "item_id string, text string")
    rows = dc.decontamination_report(spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string"), benchmark).collect()
    assert len(rows) == 3 and all((r["n_hit"], r["n_items"]) == (10, 2) for r in rows)
    assert dc.decontamination_report(spark.createDataFrame([], "doc_id long, text string"), benchmark).count() == 0
