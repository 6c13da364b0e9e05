import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.functions import text as T
from cairnspark.operators import codec
from cairnspark.sources import container
from cairnspark.streaming.incremental import PieceTokenizer

TEXT = st.text(st.characters(codec="utf-8", max_codepoint=0x24F), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.lists(st.integers(0, 80), max_size=6))
def test_any_cut_gives_the_same_terms(text, cuts):
    machine, at = PieceTokenizer(), 0
    for cut in sorted(cuts):
        machine.feed_text(text[at:cut] if cut > at else "")
        at = max(at, cut)
    machine.feed_text(text[at:])
    assert machine.finish() == (sorted({w.lower() for w in re.findall(r"[^\W_]+", text)}), text[:2048])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from(["store", "deflate", "zstd"]), st.integers(1, 700))
def test_codecs_round_trip_in_any_blocks(data, kind, size):
    payload = codec.encode(data, kind)
    blocks = (payload[k : k + size] for k in range(0, len(payload), size))
    assert b"".join(codec.decode(blocks, kind, len(data))) == data


def test_columns_agree_with_python(spark):
    """A batch of generated texts through the column expressions at once."""
    texts = [t for t in _examples(TEXT, 300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.tokens(F.col("t")).alias("w"), T.archive_path_ok(F.col("t")).alias("ok"), T.sha256(F.col("t")).alias("s")).collect()
    for r in rows:
        text = texts[r["k"]]
        assert r["w"] == [w.lower() for w in re.findall(r"[^\W_]+", text)]
        assert r["s"] == container.sha256(text.encode())
    paths = ["/".join(p) for p in _examples(st.lists(st.sampled_from(["a", "..", ".", "", "b:c", "x\\y", "é", "a.b"]), min_size=1, max_size=4), 200)]
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.archive_path_ok(F.col("p")).alias("ok")).collect()
    assert all(r["ok"] == container.safe_path(r["p"]) for r in found)


def _examples(strategy, count):
    out = []

    @settings(max_examples=count, deadline=None, database=None, derandomize=True)
    @given(strategy)
    def collect(x):
        out.append(x)

    collect()
    return out
