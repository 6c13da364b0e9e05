"""Token counts: pieces are counted once per distinct pre-token and joined to the pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import per_batch


class PieceTable:
    """Pieces of each distinct pre-token that a task has met; forgotten and begun anew beyond ``most`` entries."""

    def __init__(self, path: str, classes: tuple, most: int = 400_000):
        self.pieces, self.most, self.counts = bpe.fast(path)._encode_single_piece, most, {}
        self.special = bpe.special_tokens(path)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pretokens = bpe.PreTokens(*classes)

    def frequencies(self, texts: list[str]) -> list[Counter]:
        """How often each pre-token stands in each text; a special token's string is one pre-token."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return list(map(Counter, self.pretokens.of(texts)))
        parts = [self.cut.split(t) for t in texts]
        plain = iter(self.pretokens.of([p for row in parts for p in row if p not in self.special]))
        return [Counter(x for p in row for x in ([p] if p in self.special else next(plain))) for row in parts]

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text: distinct pre-tokens of these texts are looked up, new ones are encoded once."""
        rows = self.frequencies(texts)
        new = set().union(*rows) - self.counts.keys()
        if len(self.counts) + len(new) > self.most:
            self.counts, new = {}, set().union(*rows)
        self.counts.update((t, 1 if t in self.special else len(self.pieces(t))) for t in new)
        of = self.counts
        return [sum(n * of[piece] for piece, n in row.items()) for row in rows]


def whole_counts(path: str):
    """For tokenizers whose pre-tokens don't stand alone: the library's count of each text."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    tokenizer = bpe.library(path)
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, slice_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A narrow dependency: no row is shuffled, since documents times distinct pre-tokens would be several times the
    input.  The join of pre-token frequencies with piece counts is done where the frequencies arise, in each task,
    for a slice of texts at a time.  Null text counts as empty and has no tokens; null ids and repeated rows give
    a row each; an empty table gives none.  A very long text is a slice
    of its own.  Files that aren't plain byte-level BPE are counted by their library text by text.
    Other columns are ignored.
    """
    classes = bpe.classes(tokenizer_path) if bpe.is_byte_level(tokenizer_path) else None

    def make():
        totals = PieceTable(tokenizer_path, classes).totals if classes else whole_counts(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            n_tokens: list[int] = []
            begin = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= slice_chars or k == len(texts) - 1:
                    n_tokens += totals(texts[begin : k + 1])
                    begin, size = k + 1, 0
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = per_batch(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long", make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
