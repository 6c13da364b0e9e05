import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import text as T
from cairnspark.streaming import incremental as inc

TEXT = "Привет cloud streamingneedle ¼ a_b " + "bounded noise " * 300 + "tail"


def test_pieces_give_what_the_whole_gives(spark):
    whole = spark.createDataFrame([(TEXT,)], "t string").select(T.terms(F.col("t")).alias("w"), T.excerpt(F.col("t")).alias("x")).first()
    rng = random.Random(1)
    for size in (1, 3, 1000):
        machine, data = inc.PieceTokenizer(), TEXT.encode()
        while data:
            n = size if size == 1 else rng.randint(1, size)
            machine.feed_bytes(data[:n])
            data = data[n:]
        terms, excerpt = machine.finish()
        assert (terms, excerpt) == (whole["w"], whole["x"]) == machine.finish()
        with pytest.raises(ValueError):
            machine.feed_text("more")
    bad = inc.PieceTokenizer()
    bad.feed_bytes(b"ok \xff\xc3")
    assert bad.finish()[0] == ["ok"]


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_of_pieces(spark, tmp_path):
    rows = [(f"d{d}", k, TEXT[k * 500 : (k + 1) * 500], (k + 1) * 500 >= len(TEXT)) for d in range(3) for k in range(-(-len(TEXT) // 500))]
    for batch in range(3):
        spark.createDataFrame(rows[batch::3], "entry_id string, seq long, text string, final boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows, "entry_id string, seq long, text string, final boolean").coalesce(1).write.parquet(str(tmp_path / "whole"))
    stream = spark.readStream.schema("entry_id string, seq long, text string, final boolean").parquet(str(tmp_path / "whole"))
    drain(inc.index_pieces(stream).writeStream.format("memory").queryName("pieces").outputMode("append").option("checkpointLocation", str(tmp_path / "cp1")).start())
    want = spark.createDataFrame([(TEXT,)], "t string").select(T.terms(F.col("t"))).first()[0]
    got = spark.table("pieces").collect()
    assert len(got) == 3 and all(r["terms"] == want for r in got)


def test_running_log_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    drain(inc.log_windows(stream, "ts").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start())
    batch = rows.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())


def test_documents_share_the_state_of_a_bucket(spark, tmp_path):
    rows = [(f"d{d}", k, TEXT[k * 2000 : (k + 1) * 2000] + f" w{d}", k == 2) for d in range(60) for k in range(3)]
    rows += [("odd", 1, "dle", False), ("odd", 0, "mid", False), ("odd", 1, "dle", False), ("odd", 2, None, True), ("never", 0, "ended", False)]
    for batch in ((0,), (1, 1), (2,)):
        spark.createDataFrame([r for r in rows if r[1] in batch], "entry_id string, seq long, text string, final boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entry_id string, seq long, text string, final boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = inc.index_pieces(stream, 5).writeStream.format("memory").queryName("shared").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).start()
    query.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    whole = [(f"d{d}", "".join(r[2] for r in rows if r[0] == f"d{d}")) for d in range(60)] + [("odd", "middle")]
    want = spark.createDataFrame(whole, "entry_id string, t string").select("entry_id", T.terms(F.col("t")), T.excerpt(F.col("t")))
    assert sorted(spark.table("shared").collect()) == sorted(want.collect())
    assert len(states) == 3 and max(states) <= 5 and states[-1] == 1


def test_pieces_are_written_by_many_tasks(spark, tmp_path):
    from cairnspark.plans import archives, catalog

    texts = [(d, f"{TEXT[: 11 * d]} Straße{d}") for d in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["stream_pieces"](spark, str(tmp_path))
    want = spark.createDataFrame(texts, "d long, t string").select(T.numbered("e", F.col("d")), F.array_join(T.terms(F.col("t")), " "), T.excerpt(F.col("t")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    root = Path(archives.spot(spark, str(tmp_path)).root)
    assert len([*root.glob("pieces-*/*.parquet")]) == 12
    assert sorted(p.name for p in root.glob("state-*/commits/[0-9]*")) == ["0", "1", "2"]
