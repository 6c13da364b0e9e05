import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cairnspark.llm import jaccard_join as jj


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def brute_force(rows):
    """doc_id -> (n, component_id) from the definition, over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed, families=6, copies=12, length=60):
    rng = random.Random(seed)
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One"), (905, "one two"), (906, "one two"), (907, "ÀB c d"), (908, "Àb C D")]
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, length))]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
            if rng.random() < 0.3:
                w += [f"y{rng.randrange(9)}" for _ in range(rng.randint(0, 4))]
            rows.append((f * 100 + c, " ".join(w)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    out = jj.jaccard_join(docs, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect())


def test_matches_all_pairs(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute_force(rows)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """With tiny blocks a family is split, its heads meet, and what is left is joined block by block."""
    rows = corpus(2, families=3, copies=25, length=40)
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)
    monkeypatch.setattr(jj, "PAIR_SETS", 4)
    assert run(spark, rows) == brute_force(rows)


def test_link_sets_joins_what_all_pairs_join():
    rng = random.Random(3)
    for _ in range(30):
        base = [rng.sample(range(3000), rng.randint(3, 80)) for _ in range(5)]
        sets = []
        for _ in range(rng.randint(2, 60)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                s.discard(rng.choice(list(s)) if s else 0)
                s.add(rng.randrange(3000))
            sets.append(np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sets = [np.sort(s) for s in sets]
        parent = list(range(len(sets)))

        def root(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        def joined(pairs, parent=parent, root=root):
            parent[:] = range(len(parent))
            for x, y in pairs:
                parent[max(root(x), root(y))] = min(root(x), root(y))
            return [root(k) for k in range(len(parent))]

        exact = [(x, y) for x in range(len(sets)) for y in range(x) if jj.enough(len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y])))]
        assert joined(jj.link_sets(sets)) == joined(exact)
        label = np.array(joined(exact[: len(exact) // 2]))
        side = np.arange(len(sets)) % 2
        some = joined(exact[: len(exact) // 2] + [(x, y) for x, y in exact if side[x] != side[y]])
        assert joined(jj.link_sets(sets, label, side) + [(k, int(label[k])) for k in range(len(sets))]) == some


def test_signatures_lose_no_link():
    rng = random.Random(4)
    for n in [*range(1, 75), 100, 333, 1000, 4000]:
        for seed in range(8):
            a = set(rng.sample(range(10**6), n))
            b = set(a)
            for _ in range(rng.randint(0, n // 9 + 1)):
                (b.discard(rng.choice(sorted(b))) if rng.random() < 0.6 and len(b) > 1 else b.add(rng.randrange(10**6)))
            if a != b and 100 * len(a & b) >= 90 * len(a | b):
                sets = [np.sort(jj.mixed(np.array(sorted(s), np.uint64))) for s in (a, b)]
                owner, sig = jj.part_signatures(sets, seed)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_unrelated_short_texts_stay_apart(spark):
    """Texts of 8 to 30 common words share few signatures, however many they are."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 14) if k % 2 else rng.randint(15, 30)))) for k in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = jj.set_table(docs).persist()
    sizes = jj.candidate_groups(sets).groupBy("root").count().agg(F.max("count"), F.sum("count")).first()
    sets.unpersist()
    assert (sizes[0] or 0) < 20 and (sizes[1] or 0) < 400


def test_groups_that_chance_joined_fall_apart(spark, monkeypatch):
    """With all sets in one group at first, the second signing and the trees below it do the work."""
    rows = corpus(6, families=4, copies=9, length=50)
    real, calls = jj.candidate_groups, []

    def one_group(sets):
        calls.append(sets)
        return real(sets) if len(calls) > 1 else sets.where("n > 0").select("node", F.lit(5).cast("long").alias("root")).distinct()

    monkeypatch.setattr(jj, "candidate_groups", one_group)
    monkeypatch.setattr(jj, "BLOCK_SETS", 5)
    monkeypatch.setattr(jj, "MANY_BLOCKS", 1)
    monkeypatch.setattr(jj, "PAIR_SETS", 4)
    assert run(spark, rows) == brute_force(rows) and len(calls) == 2


def test_group_values_are_the_same_for_hot_and_cold_groups(spark):
    rows = spark.createDataFrame([(k, 0 if k % 3 else k, k % 5) for k in range(60)], "class long, group long, n long").repartition(4)
    want = {}
    for r in rows.collect():
        count, total = want.get(r["group"], (0, 0))
        want[r["group"]] = count + 1, total + r["n"]
    for share in (0.0001, 0.1, 2.0):  # groups of two rows or more are hot, the large one is, none is
        out = jj.with_group_values(rows, share, size=F.count("*"), total=F.sum("n")).collect()
        assert sorted(r["class"] for r in out) == list(range(60))
        assert all((r["size"], r["total"]) == want[r["group"]] for r in out)
    assert jj.with_group_values(rows.limit(0), 0.1, size=F.count("*")).collect() == []


def test_blocks_of_cold_groups(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SETS", 4)
    rows = corpus(8, families=3, copies=9, length=50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jj.jaccard_join(docs, hot_share=2.0).collect())) == sorted(map(tuple, jj.jaccard_join(docs).collect())) == brute_force(rows)


def test_very_long_texts_and_exact_limits(spark):
    rng = random.Random(7)
    long = [f"v{rng.randrange(50_000)}" for _ in range(30_000)]
    other = [w if rng.random() > 0.01 else "changed" for w in long]
    twenty = [f"t{k}" for k in range(22)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:20_000])), (4, " ".join(twenty)), (5, " ".join(twenty[:20])), (6, " ".join(twenty[:21])), (7, " ".join(twenty[:11])), (8, " ".join(twenty[:12]))]
    assert run(spark, rows) == brute_force(rows)


def test_sql(spark):
    for name in ("sf0.001",):
        sql = jj.ORACLE.replace("FROM documents", f"FROM '/root/testdata/{name}/documents.parquet'")
        out = jj.jaccard_join(spark.read.parquet(f"/root/testdata/{name}/documents.parquet"))
        assert sorted(map(tuple, out.collect())) == sorted(duckdb.sql(sql).fetchall())


def test_clashing_columns(spark):
    names = ["cairn_drop_id", "CAIRN_DROP_MARK", "mark", "class", "signatures"]
    docs = spark.createDataFrame([(1, "a b c", *names), (2, "A b c", *names), (3, "x", *names)], ["doc_id", "text", *names])
    out = jj.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a b c", *names), (3, "x", *names)]


def test_empty_table_nulls_and_repeats(spark):
    assert run(spark, []) == []
    out = jj.jaccard_join(spark.createDataFrame([(None, "a b c d"), (None, None), (5, "q r s"), (5, "q r s"), (5, "z"), (3, "Q R S")], "doc_id long, text string")).collect()
    assert sorted((r[0] or -1, r[1], r[2] or -1) for r in out) == [(-1, 0, -1), (-1, 2, -1), (3, 1, 3), (5, 1, 3), (5, 1, 3), (5, 1, 5)]


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "other words here"), (4, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_keep_one_with_an_id_on_several_texts(spark):
    """Only the row that links with a smaller id goes; other texts of its id stay, in components of their own or alone."""
    rows = [(1, "a b c"), (5, "A b c"), (5, "quite another text"), (6, "Quite another text"), (7, "x y z"), (3, "X y z"), (7, None), (8, "alone and whole"), (8, "alone too here"), (None, "a b c")]
    out = jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(1, "a b c"), (5, "quite another text"), (3, "X y z"), (7, None), (8, "alone and whole"), (8, "alone too here"), (None, "a b c")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
