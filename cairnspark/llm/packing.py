"""Packing of tokenised documents into training sequences by multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow

END_ID = 1
FIELDS = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))


def differencing(sizes: np.ndarray, ways: int) -> list[list[int]]:
    """Karmarkar-Karp for ``ways`` sets: indices of each set.

    Every item begins as a partial partition with one filled set.  The two partial partitions of the largest
    spread are merged again and again, fullest set with emptiest, so that their imbalances cancel.
    Sets are kept in falling order, relative to the smallest; each step costs O(ways log ways).
    """
    heap = []
    for k in np.argsort(-sizes, kind="stable"):
        sums = np.zeros(ways, np.int64)
        sums[0] = sizes[k]
        heap.append((-int(sizes[k]) if ways > 1 else 0, int(k), sums, [[int(k)]] + [None] * (ways - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, of_a = heapq.heappop(heap)
        _, other, b, of_b = heapq.heappop(heap)
        sums = a + b[::-1]
        sets = [x + y if x and y else x or y for x, y in zip(of_a, reversed(of_b), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums.min()
        heapq.heappush(heap, (-int(sums[0]), min(tie, other), sums, [sets[k] for k in order]))
    return [s for s in heap[0][3] if s] if heap else []


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sets of at most ``capacity``: the number of sets begins at the least possible and rises while one overflows."""
    total = int(sizes.sum())
    ways = max(1, -(-total // capacity))
    while True:
        sets = differencing(sizes, ways)
        worst = max((int(sizes[s].sum()) for s in sets), default=0)
        if worst <= capacity:
            return sets
        ways += max(1, (worst - capacity) * ways // (8 * capacity))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, piece_tokens: int = 512, group_pieces: int = 512, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids.

    ids are little-endian unsigned 32-bit numbers; ``sequences`` puts them together.

    A document is its ids, then ``END_ID``.  Stretches that fill whole windows stay together in windows of their
    own.  What is left of each document is cut into pieces of ``piece_tokens`` and a shorter last one, and groups
    of ``group_pieces`` such pieces are dealt into near-equal windows; pieces of one document that meet in a window
    lie there in order.  Each task packs what it reads, so ids never leave it and nothing is shuffled; a task leaves
    at most one group that is smaller than the others, whose windows can be shorter than ``capacity``.

    Null text counts as empty and packs its end id alone.  Null ids and repeated rows are documents of their own;
    an empty table gives no rows.  A very long text is encoded whole and held by one task.  Of pieces of equal size
    the one that was read first is merged first.  Other columns are ignored.
    """
    native = bpe.is_byte_level(tokenizer_path)
    fields = (*FIELDS, *((("ids", pa.binary()),) if keep_ids else ()))

    def run(batches):
        encoder = bpe.fast(tokenizer_path) if native else None
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def ids_of(text: str) -> np.ndarray:
            if native:
                return encoder.encode_to_numpy(text, allowed_special="all")
            return np.array(bpe.library(tokenizer_path).encode(text, add_special_tokens=False).ids, "<u4")

        def settle() -> list[tuple]:
            """Rows of the waiting pieces."""
            nonlocal sequence
            rows = []
            for members in windows(np.array([p[2] for p in waiting]), capacity):
                offset = 0
                for k in sorted(members):
                    rows.append((*waiting[k][:5], sequence, offset, *waiting[k][5:]))
                    offset += waiting[k][2]
                sequence += 1
            waiting.clear()
            return rows

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * (1 + len(fields))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, kind) for c, (_, kind) in zip(columns[1:], fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

        id_type = pa.int64()
        for batch in batches:
            rows = []
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(ids_of(text.as_py()), END_ID).astype("<u4")
                data, total, at = ids.tobytes(), len(ids), 0
                while at < total:
                    length = capacity if total - at >= capacity else min(piece_tokens, total - at)
                    own = memoryview(data)[4 * at : 4 * (at + length)]
                    piece, kept = (doc_id, at, length, zlib.crc32(own), total), (bytes(own),) if keep_ids else ()
                    if length == capacity:
                        rows.append((*piece, sequence, 0, *kept))
                        sequence += 1
                    else:
                        waiting.append((*piece, *kept))
                    at += length
                if len(waiting) >= group_pieces:
                    rows += settle()
            if rows:
                yield table(rows)
        if waiting:
            yield table(settle())

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n, _ in fields)
    return map_arrow(rows, run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids of pack(..., keep_ids=True): the pieces of a sequence in the order of their offsets."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.transform(parts, lambda p: p["ids"]).alias("parts"))
    return out.select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
