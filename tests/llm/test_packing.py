import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cairnspark.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fast_encoder_gives_the_library_ids():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "'s", "'LL", "12", "²", "<|endoftext|>", "!?", "\u00a0", "🙂", "x" * 50]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert bpe.fast(PATH).encode_to_numpy(text, allowed_special="all").tolist() == bpe.library(PATH).encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing():
    sizes = np.array([8, 7, 6, 5, 4])
    sets = packing.differencing(sizes, 2)
    assert sorted(itertools.chain(*sets)) == [0, 1, 2, 3, 4]
    assert sorted(int(sizes[s].sum()) for s in sets) == [14, 16]  # the known result of largest differencing
    rng = np.random.default_rng(1)
    for ways in (1, 2, 7, 40):
        sizes = rng.integers(1, 500, 300)
        sets = packing.differencing(sizes, ways)
        assert sorted(itertools.chain(*sets)) == list(range(300))
        sums = [int(sizes[s].sum()) for s in sets]
        assert max(sums) - min(sums) <= 500 and len(sets) <= ways
    assert packing.differencing(np.zeros(0, int), 1) == []


@pytest.mark.parametrize("sizes", [[2048], [1], [2047, 2, 2047], [1025, 1025, 1025], list(range(1, 400))])
def test_windows_keep_the_capacity(sizes):
    sets = packing.windows(np.array(sizes), 2048)
    assert sorted(itertools.chain(*sets)) == list(range(len(sizes))) and all(sum(sizes[k] for k in s) <= 2048 for s in sets)


def check(rows, texts, capacity=2048):
    """Every id in one piece, pieces gapless in their sequences; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*bpe.library(PATH).encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        used += at
    return 1 - used / (capacity * len(by_sequence))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(packing.pack(docs, PATH).collect(), texts) < 0.03


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 20_000, 4: "a<|endoftext|>b"}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, length int")
    out = packing.pack(docs, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), texts)
    assert packing.pack(docs.where("false"), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a"), (5, "a"), (5, "a")], "doc_id long, text string"), PATH).collect()
    assert [r["doc_tokens"] for r in twice] == [2, 2, 2]


def test_sequences_hold_the_ids(spark):
    texts = {k: f"text {k} " * (40 * k) for k in range(30)}
    pieces = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH, keep_ids=True)
    whole = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in packing.sequences(pieces).collect()}
    assert all(len(ids) <= 2048 for ids in whole.values())
    rows = pieces.drop("ids").collect()
    check(rows, texts)
    for r in rows:
        assert zlib.crc32(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes()) == r["ids_crc32"]
