"""Archives made by Spark: tasks write the parts of data, index and manifest, and the driver lays them end to end.

What grows with the archive is in the files of a staging folder beside it, which tasks and driver must share.  The
bytes are those that ``container.write_archive`` would give.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import container

#: Bytes of content, and postings held at once, of a task.
PART, POSTINGS = 16 << 20, 1_000_000
STAGED = "position long, entry_id string, chunk_id string, codec string, stored_size long, staged string, staged_at long"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FRAGMENTS = pa.schema([("term", pa.string()), ("first", pa.string()), ("ids", pa.binary())])
ENTRY = ("entry_id", "path", "kind", "size", "sha256", "media_type", "requested_method", "chunk_id", "searchable", "codec", "stored_size", "chunk_offset", "chunk_length")
OPTIONAL = ("mode", "mtime_ns", "target", "dedup_of")


class Texts:
    """A compressed text file of one task: elements with commas between them.  It is there once it has an element."""

    def __init__(self, base: str):
        self.base, self.file = base, None

    def add(self, text: str) -> None:
        if self.file is None:
            self.file = gzip.open(f"{self.base}.json", "wb", compresslevel=1)
        else:
            text = "," + text
        self.file.write(text.encode("utf-8"))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def compact(value) -> str:
    return container.canonical_json(value).decode("utf-8")


def stage(rows: DataFrame, staging: str) -> DataFrame:
    """Write payloads, documents and fragments of postings of rows that are sorted by entry_id in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(staging, exist_ok=True)
        name = uuid.uuid4().hex
        base, at, held, count, out = f"{staging}/{name}", 0, {}, 0, None

        def flush() -> None:
            nonlocal out, count
            if held:
                out = out or pq.ParquetWriter(f"{base}.postings.parquet", FRAGMENTS)
                terms = sorted(held)
                out.write_table(pa.table([terms, [held[t][0].strip('"') for t in terms], [zlib.compress(",".join(held[t]).encode(), 1) for t in terms]], schema=FRAGMENTS))
                held.clear()
                count = 0

        documents = Texts(f"{base}.documents")
        with open(f"{base}.data", "wb") as data:
            for batch in batches:
                places, sizes = [], []
                columns = [batch.column(c) for c in ("entry_id", "path", "searchable", "excerpt", "terms", "payload")]
                for values in zip(*columns, strict=True):
                    entry_id, path, searchable, excerpt, words, payload = (v.as_py() for v in values)
                    places.append(at)
                    sizes.append(None if payload is None else len(payload))
                    if payload is not None:
                        data.write(payload)
                        at += len(payload)
                    if searchable:
                        words = sorted(set(words or []))
                        head = {"entry_id": entry_id, "path": path, "excerpt": excerpt or ""}
                        documents.add(compact(entry_id) + ":" + compact(head | {"terms": words}))
                        quoted = json.dumps(entry_id)
                        for w in words:
                            held.setdefault(w, []).append(quoted)
                        count += len(words)
                        if count >= POSTINGS:
                            flush()
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("entry_id"), batch.column("chunk_id"), batch.column("codec"), pa.array(sizes, pa.int64()), pa.array([name] * n, pa.string()), pa.array(places, pa.int64())], [c.split()[0] for c in STAGED.split(", ")])
            flush()
        documents.close()
        if out:
            out.close()

    return rows.select("position", "entry_id", "path", "chunk_id", "codec", "searchable", "excerpt", "terms", "payload").mapInArrow(run, STAGED)


def entry_parts(rows: DataFrame, staging: str) -> DataFrame:
    """Write entries of rows that are sorted by position in each task: part, first, n, raw_bytes, special, methods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, texts, first, n, raw, special, methods = f"{staging}/{uuid.uuid4().hex}.entries", None, None, 0, 0, 0, {}
        for batch in batches:
            for r in batch.to_pylist():
                entry = {k: r[k] for k in ENTRY} | {k: r[k] for k in OPTIONAL if r[k] is not None}
                texts = texts or Texts(base)
                texts.add(compact(entry))
                first = r["position"] if first is None else first
                n, raw, special = n + 1, raw + r["size"], special + (r["kind"] != "file")
                methods[r["codec"]] = methods.get(r["codec"], 0) + 1
        if texts:
            texts.close()
            yield pa.RecordBatch.from_pylist([{"part": base, "first": first, "n": n, "raw_bytes": raw, "special": special, "methods": json.dumps(methods)}])

    return rows.mapInArrow(run, "part string, first long, n long, raw_bytes long, special long, methods string")


def posting_parts(rows: DataFrame, staging: str) -> DataFrame:
    """Write postings of fragments that are sorted in each task, of which none shares a term with another: part, first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, file, term, first = f"{staging}/{uuid.uuid4().hex}.postings", None, None, None
        for batch in batches:
            for t, ids in zip(batch.column("term").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                end = "],"
                if file is None:
                    file, first, end = gzip.open(f"{base}.json", "wb", compresslevel=1), t, ""
                file.write((f"{end}{compact(t)}:[" if t != term else ",").encode() + zlib.decompress(ids))
                term = t
        if file:
            file.write(b"]")
            file.close()
            yield pa.RecordBatch.from_pylist([{"part": base, "first": first}])

    return rows.mapInArrow(run, "part string, first string")


class Pieces:
    """Bytes and files that lie end to end."""

    def __init__(self, text: bytes, holes: dict[str, list[str]]):
        """``text`` with the elements of files put into its empty containers, which are named by what stands before them."""
        self.pieces: list[bytes | str] = []
        for name, files in holes.items():
            before, text = text.split(name.encode(), 1)
            self.pieces.append(before + name.encode()[:-1])
            for k, f in enumerate(files):
                self.pieces += [b",", f] if k else [f]
            text = name.encode()[-1:] + text
        self.pieces.append(text)

    def blocks(self, drop: bool = False) -> Iterator[bytes]:
        for piece in self.pieces:
            if isinstance(piece, bytes):
                yield piece
                continue
            yield from file_blocks(piece, drop, gzip.open)

    def measured(self) -> tuple[int, str]:
        digest, n = hashlib.sha256(), 0
        for block in self.blocks():
            digest.update(block)
            n += len(block)
        return n, digest.hexdigest()

    def write(self, out) -> None:
        for block in self.blocks(True):
            out.write(block)


def file_blocks(path: str, drop: bool = False, opened: Callable = open) -> Iterator[bytes]:
    with opened(path, "rb") as f:
        while data := f.read(container.BLOCK):
            yield data
    if drop:
        os.unlink(path)


def write(layout: DataFrame, prepare: Callable[[DataFrame], DataFrame], expected: int, raw_bytes: int, path: str, created_at: str, archive_id: str | None, indexed: bool, dedup: bool, overwrite: bool, sidecars: bool = True, dialect: container.Dialect = container.OWN) -> None:
    """Write the archive of a catalogue with its layout.

    ``prepare`` gives rows that own a chunk or are searchable their codec, payload (null if they own none), excerpt and
    terms, and keeps the order of rows.  Only they are read, in the order in which they lie in the archive.
    """
    spark, archive_id = layout.sparkSession, archive_id or str(uuid.uuid4())
    staging = f"{os.path.abspath(path)}.staging-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")  # each job here runs once, so its shuffle files needn't wait for the JVM's collector
        os.makedirs(staging)
        n = max(spark.sparkContext.defaultParallelism, -(-raw_bytes // PART))
        wanted = layout.where("dedup_of IS NULL OR searchable").repartitionByRange(n, "entry_id").sortWithinPartitions("entry_id")
        stage(prepare(wanted), staging).write.parquet(f"file://{staging}/staged")
        staged = spark.read.schema(STAGED).parquet(f"file://{staging}/staged")
        tasks = staged.groupBy("staged").agg(F.min("entry_id").alias("first"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("bytes")).orderBy("first").collect()  # a row for each task
        bases, data_length = [], 0
        for t in tasks:
            bases.append((t["staged"], data_length))
            data_length += t["bytes"]
        places = staged.where("stored_size IS NOT NULL").join(F.broadcast(spark.createDataFrame(bases, "staged string, base long")), "staged")
        places = places.select("chunk_id", "codec", "stored_size", (F.col("base") + F.col("staged_at")).alias("chunk_offset"), F.col("stored_size").alias("chunk_length"))
        rows = layout.drop("codec", "stored_size", "chunk_offset", "chunk_length").join(places, "chunk_id").select("position", *ENTRY, *OPTIONAL)
        parts = sorted(entry_parts(rows.repartitionByRange("position").sortWithinPartitions("position"), staging).collect(), key=lambda r: r["first"])
        count = sum(p["n"] for p in parts)
        if count != expected:
            raise container.FormatError(f"{count} of {expected} entries have a chunk")
        fragments = [f for t in tasks if os.path.exists(f := f"{staging}/{t['staged']}.postings.parquet")]
        postings = []
        if fragments:
            found = spark.read.schema("term string, first string, ids binary").parquet(*(f"file://{f}" for f in fragments))
            postings = [r["part"] for r in sorted(posting_parts(found.repartitionByRange("term").sortWithinPartitions("term", "first"), staging).collect(), key=lambda r: r["first"])]
            for f in fragments:
                os.unlink(f)
        documents = [f for t in tasks if os.path.exists(f"{(f := f'{staging}/{t["staged"]}.documents')}.json")]
        methods: dict[str, int] = {}
        for p in parts:
            for k, v in json.loads(p["methods"]).items():
                methods[k] = methods.get(k, 0) + v
        d = dialect
        manifest = {"schema": d.manifest_schema, "schema_version": max(d.manifest_versions), "archive_id": archive_id, "created_at": created_at, "dedup": dedup, "entry_count": count, "raw_bytes": sum(p["raw_bytes"] for p in parts), "entries": [], "methods": methods, "search": {"index_schema": d.index_schema, "index_schema_version": max(d.index_versions), "default_mode": "lexical", "index_built": indexed}}
        index = {"schema": d.index_schema, "schema_version": max(d.index_versions), "archive_id": archive_id, "lexical": {"documents": {}, "postings": {}}}
        holes = ({'"entries":[]': [p["part"] for p in parts]}, {'"documents":{}': documents, '"postings":{}': postings})
        sections = {}
        for part, value, filled in zip(("manifest", "index"), (manifest, index), holes, strict=True):
            sections[part] = Pieces(container.canonical_json(value), {k: [f"{f}.json" for f in v] for k, v in filled.items()})
        sizes = {part: p.measured() for part, p in sections.items()}
        header = container.header_for(archive_id, count, not any(p["special"] for p in parts), sizes, data_length, created_at, d)
        container.checked_header(header, d, None)
        block = container.canonical_json(header)
        if len(block) > d.header_size:
            raise container.FormatError("the header is too long")

        staged_archive = []

        def body(out) -> None:
            staged_archive.append(out.name)
            out.write(d.magic + block.ljust(d.header_size))
            for section in sections.values():
                section.write(out)
            written = 0
            for t in tasks:
                for data in file_blocks(f"{staging}/{t['staged']}.data", True):
                    out.write(data)
                    written += len(data)
            if written != data_length:
                raise container.FormatError(f"chunks changed while copied: {written} of {data_length} bytes")

        if os.path.exists(path) and not overwrite:
            raise container.FormatError(f"{path} exists")
        container.publish({path: body} | (container.sidecar_writers(path, lambda: staged_archive[0], d) if sidecars else {}))
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
        shutil.rmtree(staging, ignore_errors=True)
