import pytest
from pyspark.sql import functions as F

from cairnspark.functions import lineage, policy
from cairnspark.functions import text as T
from cairnspark.operators import codec, manifest, reports, rules


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "p string").select(f(F.col("p"))).collect()]


def test_paths_and_suffixes(spark):
    assert column(spark, ["a/B.TXT", ".hidden", "x/.tar.gz", "noext", "a.b/c", "dir.d/f.Md"], T.suffix) == [".txt", "", ".gz", "", "", ".md"]
    good, bad = ["a", "a/b.txt", "a-b/c d"], ["", " ", "/a", "a/", "a//b", "./a", "a/../b", "..", "a\\b", "C:/x", None]
    assert column(spark, good + bad, T.archive_path_ok) == [True] * len(good) + [False] * len(bad)
    assert column(spark, ["a/b.CAIRN", "a:b.cairn", "a.txt", "../a.cairn"], lambda c: T.remote_path_ok(c, ".cairn")) == [True, False, False, False]
    assert column(spark, ["a/b/c", "x"], lambda c: F.array_join(T.ancestors(c), "|")) == ["a|a/b", ""]


def test_globs(spark):
    import fnmatch

    names = ["a.txt", "b.TXT", "a1.md", "[x].md", "ab", "line\nend.txt"]
    for pattern in ("*.txt", "a?", "[ab]*", "[!a]*", "*", "[[]x].md"):
        assert column(spark, names, lambda c, p=pattern: c.rlike(T.glob_regex(p))) == [fnmatch.fnmatchcase(n, pattern) for n in names]


def test_policy(spark):
    assert column(spark, ["a.txt", "a.PNG", "a.zip", "a.xyz"], policy.requested_method) == ["zstd", "webp_or_store", "store", "store"]
    assert column(spark, ["app/.GIT/x", "venv", "avenv/x"], policy.has_protected_part) == [True, True, False]
    assert column(spark, ["/etc/x", "/home/etc", "etc/x", "/USR/y"], policy.below_system_root) == [True, False, False, True]


def test_walk_order_is_by_component(spark):
    names = ["a-b", "a", "a/b", "a.b"]
    ordered = spark.createDataFrame([(n,) for n in names], "p string").orderBy(F.split("p", "/")).collect()
    assert [r[0] for r in ordered] == sorted(names, key=lambda n: n.split("/"))


@pytest.mark.parametrize("bucket", [1, 3, 100])
def test_running_sums(spark, bucket):
    df = spark.createDataFrame([(k * 2, k + 1) for k in range(20)], "pos long, v long").repartition(4)
    out = {r["pos"]: (r["total"], r["n"]) for r in lineage.running(df, "pos", {"total": "v", "n": "1L"}, bucket).collect()}
    assert out == {k * 2: (sum(range(1, k + 1)), k) for k in range(20)}


def rows_of(spark, data):
    return spark.createDataFrame([(k, f"e{k}", s, len(s)) for k, s in enumerate(data)], "position long, entry_id string, sha256 string, size long")


def test_layout_with_and_without_dedup(spark):
    data = ["aa", "bbb", "aa", "", "bbb", ""]
    for parts in (1, 5):
        out = {r["entry_id"]: r for r in manifest.chunk_layout(rows_of(spark, data).repartition(parts)).collect()}
        assert [out[f"e{k}"]["chunk_offset"] for k in range(6)] == [0, 2, 0, 5, 2, 5]
        assert [out[f"e{k}"]["dedup_of"] for k in range(6)] == [None, None, "e0", None, "e1", "e3"]
        assert out["e4"]["chunk_id"].startswith("c00000001-")
    plain = manifest.chunk_layout(rows_of(spark, data), dedup=False).orderBy("position").collect()
    assert [r["chunk_offset"] for r in plain] == [0, 2, 5, 7, 7, 10]
    summary = manifest.dedup_summary(manifest.chunk_layout(rows_of(spark, data))).first()
    assert (summary["dedup_entries"], summary["unique_entries"], summary["dedup_ratio"]) == (3, 3, 0.5)


def test_prune_and_links(spark):
    paths = spark.createDataFrame([("a/.git",), ("a/.git/x",), ("a/b",), ("venv",)], "path string")
    assert sorted(map(tuple, manifest.protected_prune(paths).collect())) == [("a/.git", "protected"), ("a/b", "kept"), ("venv", "protected")]
    links = spark.createDataFrame([("a",)], "prefix string")
    assert manifest.below(paths, links, "left_anti").count() == 1


def test_every_entry_rule_has_a_case(spark):
    good = {"position": 0, "entry_id": "e", "path": "p", "kind": "file", "mode": 420, "mtime_ns": 1, "target": None, "sha256": "a" * 64, "chunk_id": "c", "size": 1, "chunk_offset": 0, "chunk_length": 1, "stored_size": 1, "codec": "store", "searchable": True}
    breaks = {"path": {"path": "../x"}, "entry-id": {"entry_id": " "}, "kind": {"kind": None}, "mode": {"mode": 0o10000}, "mtime": {"mtime_ns": -1}, "target-missing": {"kind": "symlink", "target": ""}, "target-unexpected": {"target": "t"}, "sha256": {"sha256": "A" * 64}, "chunk-id": {"chunk_id": None}, "sizes": {"size": -1}, "stored-size": {"stored_size": 2}, "codec": {"codec": "x"}, "searchable": {"searchable": None}}
    schema = "position long, entry_id string, path string, kind string, mode int, mtime_ns long, target string, sha256 string, chunk_id string, size long, chunk_offset long, chunk_length long, stored_size long, codec string, searchable boolean"
    order = [c.split()[0] for c in schema.split(", ")]
    make = lambda row: tuple(row[c] for c in order)
    cases = [make(good | {"path": "fine"})] + [make(good | {"position": k, "path": f"p{k}", "entry_id": f"e{k}"} | change) for k, change in enumerate(breaks.values(), 1)]
    found = sorted(map(tuple, rules.manifest_violations(spark.createDataFrame(cases, schema)).collect()))
    assert found == sorted((k, name) for k, name in enumerate(breaks, 1))
    assert {n for n, _ in rules.entry_rules()} == set(breaks)
    twice = spark.createDataFrame([make(good), make(good | {"position": 1})], schema)
    assert {r["rule"] for r in rules.manifest_violations(twice, data_length=0).collect()} == {"duplicate-path", "duplicate-entry-id", "chunk-bounds"}
    assert {r["rule"] for r in rules.total_violations(twice, 3, 2).collect()} == {"entry-count"}


def test_alignment_and_restore(spark):
    left = spark.createDataFrame([("e1", "a"), ("e2", "b")], "entry_id string, path string")
    docs = spark.createDataFrame([("e1", "a"), ("e2", "x"), ("e9", "b")], "entry_id string, path string")
    assert sorted(map(tuple, manifest.alignment(left, docs).collect())) == [("e2", "path"), ("e9", "unknown")]
    one = spark.createDataFrame([("field", 1)], "status string, dimensions int")
    two = spark.createDataFrame([("field", None)], "status string, dimensions int")
    assert [tuple(r) for r in rules.descriptor_mismatch(one, two, ["status", "dimensions"]).collect()] == [("dimensions", "1", None)]


def test_codecs():
    noise = bytes((i * 7919 + 13) % 256 for i in range(4096))
    import os

    random = os.urandom(4096)
    assert codec.choose(b"x" * 4096, "zstd", "deflate", True)[0] == "zstd"
    assert codec.choose(b"x" * 4096, "zstd", "deflate", False)[0] == "deflate"
    assert codec.choose(random, "zstd", "deflate", True) == ("store", random)
    assert codec.choose(b"x" * 4096, "store", "store", True)[0] == "store"
    for data in (b"", b"abc" * 100_000, noise, random):
        for kind in ("store", "deflate", "zstd"):
            payload = codec.encode(data, kind)
            cut = [payload[k : k + 100] for k in range(0, len(payload), 100)]
            assert b"".join(codec.decode(iter(cut), kind, len(data))) == data
            if kind != "store":
                for wrong in (payload[:-1], payload + b"x"):
                    with pytest.raises(codec.CodecError):
                        b"".join(codec.decode(iter([wrong]), kind, len(data)))
            with pytest.raises(codec.CodecError):
                b"".join(codec.decode(iter([payload]), kind, len(data) + 1))
    with pytest.raises(codec.CodecError):
        b"".join(codec.decode(iter([codec.encode(b"x" * 10_000_000, "zstd")]), "zstd", 1000))


def test_compress_and_decompress(spark):
    data = [("e1", "zstd", "deflate", b"abc" * 1000), ("e2", "store", "store", b"xyz"), ("e3", "zstd", "deflate", b"")]
    rows = spark.createDataFrame([(*d, len(d[3])) for d in data], "entry_id string, requested_method string, codec string, content binary, size long").withColumn("sha256", F.sha2("content", 256))
    packed = codec.compress(rows)
    assert {r["entry_id"]: bytes(r["content"]) for r in codec.decompress(packed).collect()} == {d[0]: d[3] for d in data}
    assert {r["codec"]: r["files"] for r in codec.analyze(rows).collect()} == {"zstd": 1, "store": 2}


def test_reports(spark):
    log = spark.createDataFrame([(100, 40), (None, 5), (10, None)], "raw_bytes long, packed_bytes long")
    assert tuple(reports.savings_summary(log).first()) == (3, 110, 45, 65)
    runs = spark.createDataFrame([("pack", 1000, float("inf"), 5, 10), ("pack", 1000, 2.0, 50, 9999)], "operation string, size_bytes long, seconds double, peak_rss_bytes long, temp_bytes long")
    assert [(r["rss_ok"], r["temp_ok"]) for r in reports.slo(runs, 10, 2.1, 1.1, 0).collect()] == [(True, True), (False, False)]
    assert [r["mib_per_second"] is None for r in reports.throughput(runs).collect()] == [True, False]
    assert tuple(reports.passed(reports.slo(runs, 10, 2.1, 1.1, 0)).first()) == (False, 1)
    assert reports.redact(spark.createDataFrame([("a", "x")], "operation string, secret string"), reports.ACTION_FIELDS, F.lit("now")).columns == ["operation", "schema_version", "timestamp"]
