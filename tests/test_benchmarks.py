import os

from cairnspark.operators import archive, benchmarks
from cairnspark.sources import synthetic


def test_generated_inputs(spark):
    text = synthetic.blocks(spark, 100_000, block=4096).orderBy("position").collect()
    data = b"".join(bytes(r["content"]) for r in text)
    assert len(data) == 100_000 and data[:16] == b"synthetic block\n" and data[4096:4112] == data[:16]
    binary = b"".join(bytes(r["content"]) for r in synthetic.blocks(spark, 700, "stored-binary", 512).orderBy("position").collect())
    assert binary == (bytes(range(256)) * 3)[:700] or binary[:512] == bytes(range(256)) * 2
    rows = synthetic.files(spark, 24, 64, 4).collect()
    assert len({r["content"] for r in rows}) == 24 - 5 and all(len(r["content"]) == 64 for r in rows)


def test_resume_takes_only_the_same_settings(spark, tmp_path):
    path = str(tmp_path / "runs.json")
    assert benchmarks.resume(spark, path, {"a": 1}).count() == 0
    benchmarks.save(path, {"a": 1}, [{"size_bytes": 5, "status": "passed", "profile": "x", "seconds": 1.0}, {"size_bytes": 7, "status": "failed"}])
    done = benchmarks.resume(spark, path, {"a": 1})
    assert [r["size_bytes"] for r in done.collect()] == [5]
    assert sorted(r["size_bytes"] for r in benchmarks.left_to_do(spark, [5, 7, 9], done).collect()) == [7, 9]
    assert benchmarks.resume(spark, path, {"a": 2}).count() == 0
    (tmp_path / "runs.json").write_text("{")
    assert benchmarks.resume(spark, path, {"a": 1}).count() == 0


def test_sizes_and_memory(spark, tmp_path):
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("12345")
    (tmp_path / "t/sub/b.bin").write_bytes(b"123")
    archive.register(spark)
    tree = spark.read.format("filetree").load(str(tmp_path / "t"))
    assert tuple(benchmarks.tree_size(tree).first()) == (2, 8) and tuple(benchmarks.tree_size(tree, "*.txt").first()) == (1, 5)
    found = benchmarks.process_memory()
    assert found["peak"] > 1_000_000 and found["source"] in ("procfs", "getrusage")
    assert benchmarks.process_memory(os.getpid())["rss"] > 0 and benchmarks.process_memory(2**22 + 1)["source"] == "unavailable"
    df = spark.createDataFrame([(1, None, 5)], "a long, b long, c long")
    assert df.select(benchmarks.peak(["a", "b", "c"])).first()[0] == 5
