import random

import public_tokenizers
import pytest
import sentencepiece

from cairnspark.llm import bpe, token_counts

TEXTS = ["", "Hello world, it's 12 o'clock", "a  b\n\n c \t", "naïve 漢字 ² 🙂", "x<|endoftext|>y <|endoftext|>", "<|endof", "word " * 5000, "y" * 20_000, " ", "A B c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_counts(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)] + [(90, None, ""), (None, "a", ""), (1, TEXTS[1], "")], "doc_id long, text string, n_bytes string").repartition(3)
    out = token_counts.token_counts(docs, path)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        count = lambda t: len(bpe.library(path).encode(t, add_special_tokens=False).ids)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "a" if r["doc_id"] is None else "" if r["doc_id"] == 90 else TEXTS[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 512)
    assert token_counts.token_counts(docs.where("false"), path).count() == 0


def test_whole_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()} == {k: len(bpe.library(path).encode(t, add_special_tokens=False).ids) for k, t in texts.items()}


def test_a_full_table_is_begun_anew():
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = token_counts.PieceTable(path, bpe.classes(path), most=5)
    for text in ("one two three four", "five six seven eight nine ten", "one two"):
        assert table.totals([text, text]) == [len(bpe.library(path).encode(text).ids)] * 2


BYTE = bpe.byte_of()


def library_pretokens(path, text):
    return [bytes(BYTE[c] for c in piece).decode() for piece, _ in bpe.library(path).pre_tokenizer.pre_tokenize_str(text)]


def test_every_code_point_is_cut_as_the_library_cuts_it():
    """Also those that Python's Unicode version doesn't know yet."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = bpe.PreTokens(*bpe.classes(path))
    for low in range(0, 0x110000, 4096):
        texts = [f"a{chr(c)}1{chr(c)}!{chr(c)}'s{chr(c)} {chr(c)}" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        assert cut.of(texts) == [library_pretokens(path, t) for t in texts]


def test_random_texts_are_cut_as_the_library_cuts_them():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut, rng = bpe.PreTokens(*bpe.classes(path)), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'x", "a", "B", "é", "1", "!", "\u3000", "\0", "'t", "'ve", "'m", "'d", "s", "l", "\U000323b0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(20_000)] + [""] * 3
    assert cut.of(texts) == [library_pretokens(path, t) for t in texts]
    totals = token_counts.PieceTable(path, bpe.classes(path)).totals(texts)
    assert totals == [len(e) for e in bpe.library(path).encode_batch(texts, add_special_tokens=False)]


def test_which_files_are_byte_level(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.is_byte_level(path) and not bpe.is_byte_level(public_tokenizers.path("word_bpe_49k.json"))
    import json

    other = json.loads(json.dumps(bpe.describe(path)))
    other["model"]["merges"][5:7] = other["model"]["merges"][6:4:-1]
    (tmp_path / "other.json").write_text(json.dumps(other))
    assert not bpe.is_byte_level(str(tmp_path / "other.json"))  # merged in another order than its ids
