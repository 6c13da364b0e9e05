"""Streams: a tokenizer that takes a document in pieces, and running aggregates of logs and postings."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import EXCERPT


WORD = re.compile(r"[^\W_]+")  # what str.isalnum() says of each character


@dataclass
class PieceTokenizer:
    """Terms and excerpt of a text that comes in pieces; the same as those of the whole, wherever it is cut."""

    decoder: codecs.IncrementalDecoder = field(default_factory=lambda: codecs.getincrementaldecoder("utf-8")("replace"))
    carry: str = ""
    terms: set[str] = field(default_factory=set)
    excerpt: str = ""
    finished: bool = False

    def feed_bytes(self, data: bytes) -> None:
        self.feed_text(self.decoder.decode(data))

    def feed_text(self, text: str, final: bool = False) -> None:
        if self.finished:
            raise ValueError("the text is finished")
        if len(self.excerpt) < EXCERPT:
            self.excerpt += text[: EXCERPT - len(self.excerpt)]
        text = self.carry + text
        words = WORD.findall(text)
        self.carry = words.pop() if words and not final and text[-1].isalnum() else ""
        self.terms.update(word.lower() for word in set(words))

    def finish(self) -> tuple[list[str], str]:
        """Sorted terms and the excerpt; may be called again."""
        if not self.finished:
            self.feed_text(self.decoder.decode(b"", True), final=True)
            self.finished = True
        return sorted(self.terms), self.excerpt


STATE = "unfinished binary"
OUT = "entry_id string, terms array<string>, excerpt string"


def _load(state: GroupState) -> dict[str, tuple[PieceTokenizer, int]]:
    """Of each unfinished document of a bucket: its tokenizer and the next piece."""
    rows = json.loads(zlib.decompress(state.get[0])) if state.exists else []
    return {key: (PieceTokenizer(carry=carry, terms=set(terms.split()), excerpt=excerpt), at) for key, carry, terms, excerpt, at in rows}


def _save(state: GroupState, unfinished: dict[str, tuple[PieceTokenizer, int]]) -> None:
    """Words hold no space, so they are one string; a compressed bucket takes a fraction of the state store's memory and disk."""
    rows = [(key, m.carry, " ".join(sorted(m.terms)), m.excerpt, int(at)) for key, (m, at) in unfinished.items()]
    if rows:
        state.update((zlib.compress(json.dumps(rows, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1),))
    elif state.exists:
        state.remove()


def _advance(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    unfinished, done = _load(state), {}
    rows = [row for frame in frames for row in zip(*(frame[c].tolist() for c in ("entry_id", "seq", "text", "final")), strict=True)]
    for key, seq, text, final in sorted(rows, key=lambda row: row[1]):
        machine, at = done.get(key) or unfinished.get(key) or (PieceTokenizer(), 0)
        if seq < at:
            continue  # a piece that came twice
        machine.feed_text(text or "", bool(final))
        if final or key in done:
            unfinished.pop(key, None)
            done[key] = machine, seq + 1
        else:
            unfinished[key] = machine, seq + 1
    _save(state, unfinished)
    if done:
        yield pd.DataFrame({"entry_id": [*done], "terms": [sorted(m.terms) for m, _ in done.values()], "excerpt": [m.excerpt for m, _ in done.values()]})


def index_pieces(pieces: DataFrame, buckets: int = 1024) -> DataFrame:
    """Documents of a stream of pieces(entry_id, seq, text, final), each given out once its final piece has come.

    Documents share a state by bucket of their id, as a group of its own for each costs milliseconds.  A bucket's
    state is written whole when one of its documents moves on, so ``buckets`` should grow with the documents under way;
    it has to stay the same for as long as the stream's checkpoint is used.
    """
    bucket = F.pmod(F.xxhash64("entry_id"), F.lit(buckets))
    return pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def running_postings(documents: DataFrame) -> DataFrame:
    """Entries by term over a stream of documents(entry_id, terms); complete or update mode."""
    return documents.select(F.explode("terms").alias("term"), "entry_id").groupBy("term").agg(F.count("*").alias("entries"))


def log_windows(log: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Records and value of an append log by window and type; records later than ``late`` are left out."""
    rows = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def running_savings(log: DataFrame) -> DataFrame:
    """The savings summary of a stream of log records; complete mode."""
    out = log.groupBy().agg(F.count("*").alias("records"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"), F.coalesce(F.sum("packed_bytes"), F.lit(0)).alias("packed_bytes"))
    return out.withColumn("saved_bytes", F.col("raw_bytes") - F.col("packed_bytes"))
