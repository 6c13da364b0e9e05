import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import quality as q


def test_rules_find_a_conjunction_and_few_of_them():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(q.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    model = q.fit(x, y)
    assert np.mean([(model.score(r) > 0.5) == t for r, t in zip(x, y, strict=True)]) > 0.97
    blind = np.array([model.score([*r[:2], 0.9, *r[3:5], 0.1, *r[6:]]) for r in x[:200]])
    assert (blind > 0.5).mean() > 0.97  # the other statistics hardly matter


def test_columns_score_as_the_rules_do(spark):
    model = q.Ensemble(0.25, ((((0, True, 3.0), (4, False, 0.1)), 1.5), (((1, False, 2.0),), -2.0)))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["", "a b c", "123 456 789", "long words here and more"])], "doc_id long, text string")
    rows = q.with_statistics(docs).withColumn("score", model.column()).collect()
    for r in rows:
        assert r["score"] == pytest.approx(model.score([r[s] for s in q.STATISTICS]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = q.quality(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id", "left").collect()
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(q.quality(docs, labels).collect()) == sorted(q.quality(docs, flipped).collect())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "a", "c"), (2, "", "c"), (3, "word " * 50_000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, 0), (3, 1, 0), (None, 0, 0), (99, 0, 0)], none.schema)
    for labels in (none, some):
        rows = q.quality(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert q.quality(docs.where("false"), some).count() == 0


def test_statistics_against_a_plain_count():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = "".join(rng.choice(list("aB1 .,!#é\n\tw"), rng.integers(1, 120)))
        got = dict(zip(q.STATISTICS, q.statistics(text), strict=True))
        data = text.encode()
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        n, n_words = len(data), max(1, len(words))
        pairs = list(zip(words, words[1:], strict=False))
        want = {
            "chars": len(text), "words": len(words), "word_length": sum(map(len, words)) / n_words, "upper": text.count("B") / n, "digit": text.count("1") / n, "mark": (text.count(".") + text.count(",")) / n,
            "symbol": (text.count("!") + text.count("#")) / n, "bang": text.count("!") / n, "wide": 2 * text.count("é") / n, "space": sum(c in " \t\n" for c in text) / n, "lines": len(lines),
            "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "line_length": n / max(1, len(lines)), "distinct_words": len(set(words)) / n_words, "top_word": max([words.count(w) for w in words], default=0) / n_words,
            "long_words": sum(len(w) > 12 for w in words) / n_words, "short_words": sum(len(w) <= 2 for w in words) / n_words, "entropy": -sum(data.count(b) / n * np.log2(data.count(b) / n) for b in set(data)),
            "repeated_pairs": sum(pairs.count(p) > 1 for p in pairs) / n_words, "links": 0.0,
        }
        for name, value in want.items():
            assert got[name] == pytest.approx(value), (name, text)


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, target = rng.integers(0, 9, (60, 4)).astype(float), rng.normal(size=60) * 3
        cuts = [np.unique(x[:, k])[:-1] for k in range(4)]
        bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)
        paths = q.tree_paths(x, cuts, bins, target, np.arange(60), 1, 5)
        gains = {}
        for k in range(4):
            for cut in cuts[k]:
                low = target[x[:, k] <= cut]
                high = target[x[:, k] > cut]
                if min(len(low), len(high)) >= 5:
                    gains[k, cut] = low.sum() ** 2 / len(low) + high.sum() ** 2 / len(high)
        best = max(gains.values())
        if best > target.sum() ** 2 / 60 + 0.5:
            (tests, rows), (_, others) = paths
            assert gains[tests[0][0], tests[0][2]] == pytest.approx(best)
            assert sorted([*rows, *others]) == list(range(60)) and all(x[rows, tests[0][0]] <= tests[0][2])
        else:
            assert paths == []


def test_lasso_weights_are_the_optimum():
    """At the optimum the slope of the loss is the penalty where a weight isn't 0, and no more than it elsewhere."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=(400, 12)).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - z[:, 1])))).astype(float)
    w, b = q.lasso(z, y, 0.02, 2000)
    error = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = z.T @ error / 400
    assert abs(error.mean()) < 1e-3 and 2 <= (w != 0).sum() < 12
    assert np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3) and (np.abs(slope[w == 0]) <= 0.021).all()


def test_repeated_ids_do_not_multiply_what_is_learned_from(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(300)] + [(k, "other words") for k in range(8, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7, 20)] * 3, "doc_id long, quality int, toxic int")
    seen = []
    real, q.fit = q.fit, lambda x, y: (seen.append(len(x)), real(x, y))[1]
    try:
        assert q.quality(docs, labels).count() == 312 and seen[0] <= 13
    finally:
        q.fit = real
