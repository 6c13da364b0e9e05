import fnmatch
import random
import re

from cairnspark.llm import url_filter as uf


def as_regex(glob):
    return re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.findall(r"\*\*|.", glob, re.DOTALL)), re.DOTALL)


def test_automaton_matches_regular_expressions():
    rng = random.Random(1)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
        texts = ["".join(rng.choice("ab/.é\n") for _ in range(rng.randint(0, 40))) for _ in range(40)] + [g.replace("*", "a") for g in globs]
        got = uf.Globs(globs).match(texts)
        assert got.tolist() == [[bool(as_regex(g).fullmatch(t)) for g in globs] for t in texts]
    assert uf.Globs(["a*"]).match([]).shape == (0, 1)
    assert fnmatch.fnmatchcase("ab", "a*")


CASES = {
    None: ("", "", None, "allow"),
    "nothing here": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "http://EXAMPLE.org/es/x?q#f": ("example.org", "/es/x", "example.org/es/", "block"),
    "http://www.example.org/en/1": ("www.example.org", "/en/1", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "https://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
    "https://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"),
    "https://com/de/x": ("com", "/de/x", "com/de/", "block"),
    "http://example.org": ("example.org", "", None, "allow"),
    "http://evil.net/x.org/y": ("evil.net", "/x.org/y", None, "allow"),
    "http://spam-farm.net/a": ("spam-farm.net", "/a", None, "block"),
    "http://a.net/login?x": ("a.net", "/login", None, "block"),
    "http://a.net/p?x=/login": ("a.net", "/p", None, "allow"),
    "ftp://a://b/c": ("a:", "//b/c", None, "allow"),
    "http://a.net/" + "long/" * 5000 + "x.zip": ("a.net", "/" + "long/" * 5000 + "x.zip", None, "block"),
}


def test_cases(spark):
    urls = list(CASES)
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(None, "http://b.org/", "clash"), (1, urls[1], "clash")], "page_id long, url string, host string")
    out = uf.url_filter(pages).collect()
    assert len(out) == len(urls) + 2
    assert {urls[r["page_id"]]: tuple(r)[1:] for r in out if r["page_id"] is not None} == CASES
    assert uf.url_filter(pages.where("false")).count() == 0


def test_sql(spark):
    import duckdb

    want = duckdb.sql(uf.ORACLE.replace("FROM pages", "FROM '/root/testdata/sf0.01/pages.parquet'")).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in uf.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect())
