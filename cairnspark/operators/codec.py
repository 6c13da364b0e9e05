"""Compression of payloads in tasks: the first codec that makes a payload smaller is taken."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFLATE_LEVEL, ZSTD_LEVEL = 9, 3


class CodecError(ValueError):
    """A payload that its codec doesn't decode to what was promised."""


def zstd_available() -> bool:
    try:
        import zstandard  # noqa: F401
    except ImportError:
        return False
    return True


def encode(data: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.compress(data, DEFLATE_LEVEL)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data)
    return data


def decode(blocks: Iterator[bytes], codec: str, size: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Decoded blocks of a payload of ``size`` bytes; a short, long or damaged payload is an error.

    Never more than a block beyond ``size`` is decoded, so a bomb is found out early.
    """
    total = 0

    def counted(block: bytes) -> bytes:
        nonlocal total
        total += len(block)
        if total > size:
            raise CodecError("the payload decodes to more than its size")
        return block

    if codec == "store":
        for block in blocks:
            yield counted(block)
    elif codec == "deflate":
        machine = zlib.decompressobj()
        try:
            for block in blocks:
                if machine.eof:
                    raise CodecError("bytes behind the payload")
                while block and not machine.eof:
                    yield counted(machine.decompress(block, step))
                    block = machine.unconsumed_tail
            yield counted(machine.flush())
        except zlib.error as error:
            raise CodecError("damaged payload") from error
        if not machine.eof or machine.unused_data:
            raise CodecError("the payload is cut short or goes on")
    elif codec == "zstd":
        import zstandard

        machine = zstandard.ZstdDecompressor().decompressobj()
        try:
            for block in blocks:
                for at in range(0, len(block), 65_536):
                    if machine.eof:
                        raise CodecError("bytes behind the payload")
                    yield counted(machine.decompress(block[at : at + 65_536]))
        except zstandard.ZstdError as error:
            raise CodecError("damaged payload") from error
        if not machine.eof or machine.unused_data:
            raise CodecError("the payload is cut short or goes on")
    else:
        raise CodecError(f"unknown codec {codec!r}")
    if total != size:
        raise CodecError(f"{total} of {size} bytes")


def choose(data: bytes, method: str, default: str, zstd: bool) -> tuple[str, bytes]:
    """Codec and payload: zstd where it was asked for and is there, else deflate; the raw bytes if none is smaller."""
    if default == "store":
        return "store", data
    for codec in (("zstd", "deflate") if method == "zstd" and zstd else (default,)):
        payload = encode(data, codec)
        if len(payload) < len(data):
            return codec, payload
    return "store", data


def compress(rows: DataFrame, zstd: bool | None = None, keep_payload: bool = True) -> DataFrame:
    """``rows`` (requested_method, codec, content: binary, ...) with the chosen codec, stored_size and payload.

    Whether zstd is there is decided once, on the driver, so that all tasks agree.
    """
    zstd = zstd_available() if zstd is None else zstd
    others = [c for c in rows.columns if c not in ("content", "codec")]
    types = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            picked = [choose(c.as_py() or b"", m, d, zstd) for c, m, d in zip(batch.column("content"), batch.column("requested_method").to_pylist(), batch.column("codec").to_pylist(), strict=True)]
            columns = [*(batch.column(c) for c in others), pa.array([c for c, _ in picked], pa.string()), pa.array([len(p) for _, p in picked], pa.int64())]
            names = [*others, "codec", "stored_size"]
            if keep_payload:
                columns.append(pa.array([p for _, p in picked], pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "codec string, stored_size long", *(["payload binary"] if keep_payload else [])])
    return rows.select(*others, "codec", "content").mapInArrow(run, schema)


def decompress(rows: DataFrame) -> DataFrame:
    """entry_id, content of rows(entry_id, codec, size, sha256, payload); size and digest are verified."""

    def run(batches):
        for batch in batches:
            r = batch.to_pydict()
            data = [b"".join(decode(iter([p]), c, n)) for p, c, n in zip(r["payload"], r["codec"], r["size"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("entry_id"), pa.array(data, pa.binary()), batch.column("sha256")], ["entry_id", "content", "sha256"])

    out = rows.select("entry_id", "codec", "size", "sha256", "payload").mapInArrow(run, "entry_id string, content binary, sha256 string")
    checked = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "entry_id")))
    return out.select("entry_id", checked.alias("content"))


def analyze(rows: DataFrame) -> DataFrame:
    """Files, raw and packed bytes and what would be saved by codec, before dedup and metadata."""
    sized = compress(rows, keep_payload=False)
    out = sized.groupBy("codec").agg(F.count("*").alias("files"), F.sum("size").alias("raw_bytes"), F.sum("stored_size").alias("packed_bytes"))
    return out.withColumn("saved_pct", F.when(F.col("raw_bytes") == 0, F.lit(0.0)).otherwise(F.bround((F.col("raw_bytes") - F.col("packed_bytes")) / F.col("raw_bytes") * 100, 2)))
