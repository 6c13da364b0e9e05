"""A data source for archives: metadata sections as tables, payload by byte range, and a writer that publishes whole.

Reading a metadata section never reads payload.  ``section`` is header, entries, documents, postings or payload.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..operators import codec
from . import container

ENTRY = "entry_id string, position long, path string, kind string, size long, sha256 string, media_type string, requested_method string, codec string, stored_size long, chunk_id string, chunk_offset long, chunk_length long, searchable boolean, mode int, mtime_ns long, target string, dedup_of string"
SCHEMAS = {
    "header": "container string, format_version int, created_at string, archive_id string, header_offset long, header_length long, manifest_offset long, manifest_length long, manifest_sha256 string, index_offset long, index_length long, index_sha256 string, data_offset long, data_length long, archive_size long, entry_count long",
    "entries": ENTRY,
    "documents": "entry_id string, path string, excerpt string, terms array<string>",
    "postings": "term string, entry_id string",
    "payload": "entry_id string, path string, content binary",
}
WRITE = "position long, entry_id string, path string, kind string, size long, sha256 string, media_type string, requested_method string, codec string, stored_size long, chunk_id string, searchable boolean, mode int, mtime_ns long, target string, dedup_of string, excerpt string, terms array<string>, payload binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def local_path(options) -> str:
    return options["path"].removeprefix("file://").removeprefix("file:")


def dialect_of(options) -> container.Dialect:
    return container.Dialect(**json.loads(options["dialect"]) | {"magic": json.loads(options["dialect"])["magic"].encode()}) if "dialect" in options else container.OWN


@dataclass
class Part(InputPartition):
    rows: list[tuple]
    block: container.Block | None
    data_offset: int


class Bundle(DataSource):
    """``spark.read.format("bundle").option("section", ..).load(archive)``."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        section = self.options.get("section", "entries")
        if section not in SCHEMAS:
            raise container.FormatError(f"no section {section!r}")
        return SCHEMAS[section]

    def reader(self, schema) -> DataSourceReader:
        return BundleReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.names != names(WRITE):
            raise container.FormatError(f"rows to write have the columns {names(WRITE)}")
        return BundleWriter(self.options, overwrite)


class BundleReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.section, self.dialect = local_path(options), options.get("section", "entries"), dialect_of(options)
        self.block = int(options.get("rows_per_task", "20000"))
        self.terms: set[str] | None = None
        self.opened: tuple[int, int] | None = None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802  the base class names it
        """Equality on ``term`` is answered from the posting dictionary; other filters stay with Spark."""
        for f in filters:
            if self.section == "postings" and isinstance(f, (EqualTo, In)) and f.attribute == ("term",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.terms = wanted if self.terms is None else self.terms & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Places of blocks of a section.  The driver scans the metadata and checks it, and keeps none of it."""
        self.opened = self.state()
        found =container.scan_archive(self.path, self.dialect, self.block)
        if self.section == "header":
            return [Part([tuple(found.header[n] for n in names(SCHEMAS["header"]))], None, 0)]
        blocks = found.blocks[self.section]
        if self.terms is not None:
            blocks = [b for b in blocks if any(b.least <= t <= b.greatest for t in self.terms)]
        start = found.header["index_offset" if self.section in ("documents", "postings") else "manifest_offset"]
        return [Part([], container.Block(start + b.offset, b.length, b.first), found.header["data_offset"]) for b in blocks] or [Part([], None, 0)]

    def state(self) -> tuple[int, int]:
        """Size and time of the archive; places that were found in another one don't hold."""
        info = os.stat(self.path)
        return info.st_size, info.st_mtime_ns

    def _entries(self, entries: list[dict], first: int) -> Iterator[tuple]:
        for k, e in enumerate(entries, first):
            yield tuple(e.get(n, {"position": k, "kind": "file"}.get(n)) for n in names(ENTRY))

    def _payload(self, entries: list[dict], data_offset: int) -> Iterator[tuple]:
        for e in entries:
            if e.get("kind", "file") == "file":
                data = b"".join(decoded(self.path, data_offset + e["chunk_offset"], e["chunk_length"], e["codec"], e["size"]))
                if container.sha256(data) != e["sha256"]:
                    raise container.FormatError(f"{e['path']}: digest")
                yield e["entry_id"], e["path"], data

    def read(self, partition: Part) -> Iterator[tuple]:
        block = partition.block
        if block is None:
            yield from (tuple(r) for r in partition.rows)
            return
        if self.opened not in (None, self.state()):
            raise container.FormatError(f"{self.path} changed after it was opened")
        data =container.file_range(self.path)(block.offset, block.length)
        found = container.block_of(data, container.Block(0, block.length, 0), self.section, self.section in ("documents", "postings"))
        if self.section == "entries":
            yield from self._entries(found, block.first)
        elif self.section == "payload":
            yield from self._payload(found, partition.data_offset)
        elif self.section == "documents":
            yield from ((i, d["path"], d.get("excerpt", ""), list(d.get("terms", []))) for i, d in found.items())
        else:
            yield from ((t, i) for t, ids in found.items() if self.terms is None or t in self.terms for i in ids)


def sidecar(spark: SparkSession, archive: str, rows: int = 20_000) -> DataFrame:
    """Entries of the manifest beside an archive; the driver finds blocks of them, which are read in tasks."""
    path, cut = f"{archive}.manifest.json", container.Cutter(rows)
    source = container.Json(container.mapped(path, 0, os.path.getsize(path)), "manifest")
    for name in source.members():
        for _ in source.items(cut) if name == "entries" else [source.value()]:
            pass
    schema = {n: {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string()) for n, t in (c.split() for c in ENTRY.split(", "))}

    def run(batches):
        for batch in batches:
            for offset, length, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = container.block_of(container.file_range(path)(offset, length), container.Block(0, length, first), "manifest")
                entries = [{"position": k, "kind": "file"} | e for k, e in enumerate(found, first)]
                yield pa.RecordBatch.from_arrays([pa.array([e.get(n) for e in entries], t) for n, t in schema.items()], [*schema])

    blocks = spark.createDataFrame([(b.offset, b.length, b.first) for b in cut.blocks], "offset long, length long, first long")
    return blocks.repartition(max(1, len(cut.blocks))).mapInArrow(run, ENTRY)


def decoded(archive: str, offset: int, length: int, kind: str, size: int) -> Iterator[bytes]:
    """Decoded blocks of one chunk, read block by block."""

    def blocks() -> Iterator[bytes]:
        with open(archive, "rb") as f:
            f.seek(offset)
            left = length
            while left:
                data = f.read(min(left, container.BLOCK))
                if not data:
                    raise container.FormatError(f"{archive}: the chunk at {offset} is cut short")
                left -= len(data)
                yield data

    return codec.decode(blocks(), kind, size)


@dataclass
class Staged(WriterCommitMessage):
    rows: list[dict]


class BundleWriter(DataSourceWriter):
    """Tasks stage payload under names of their own attempt; the commit uses only what committed tasks name.

    The folder beside the archive must be one that tasks and driver share.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.dialect, self.overwrite = local_path(options), dialect_of(options), overwrite
        self.created_at, self.archive_id = options.get("created_at", ""), options.get("archive_id") or str(uuid.uuid4())
        self.indexed, self.dedup = options.get("index", "true") == "true", options.get("dedup", "true") == "true"
        self.staging = f"{os.path.abspath(self.path)}.staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        attempt, rows = uuid.uuid4().hex, []
        for k, row in enumerate(iterator):
            r = row.asDict()
            payload = r.pop("payload")
            if payload is not None:
                r["staged"] = f"{self.staging}/{attempt}-{k}"
                with open(r["staged"], "wb") as f:
                    f.write(payload)
                r["stored_size"] = len(payload)
            rows.append(r)
        return Staged(rows)

    def commit(self, messages) -> None:
        try:
            if os.path.exists(self.path) and not self.overwrite:
                raise container.FormatError(f"{self.path} exists")
            rows = sorted((r for m in messages if m for r in m.rows), key=lambda r: r["position"])
            place, order, at = {}, [], 0
            for r in rows:
                if r["chunk_id"] not in place and "staged" in r:
                    place[r["chunk_id"]] = (at, r["stored_size"], r["codec"])
                    order.append(r["staged"])
                    at += r["stored_size"]
            manifest, index = self.documents_of(rows, place)
            container.write_archive(self.path, manifest, index, order, self.created_at, self.dialect)
        finally:
            self.abort(messages)

    def documents_of(self, rows: list[dict], place: dict) -> tuple[dict, dict]:
        """Manifest and index, from metadata only."""
        entries, documents, postings, methods = [], {}, {}, {}
        for r in rows:
            offset, length, kind = place[r["chunk_id"]]
            entry = {n: r[n] for n in ("entry_id", "path", "kind", "size", "sha256", "media_type", "requested_method", "chunk_id", "searchable")}
            entry |= {"codec": kind, "stored_size": length, "chunk_offset": offset, "chunk_length": length}
            entry |= {n: r[n] for n in ("mode", "mtime_ns", "target", "dedup_of") if r[n] is not None}
            entries.append(entry)
            methods[kind] = methods.get(kind, 0) + 1
            if r["searchable"] and self.indexed:
                terms = sorted(set(r["terms"] or []))
                documents[r["entry_id"]] = {"entry_id": r["entry_id"], "path": r["path"], "excerpt": r["excerpt"] or "", "terms": terms}
                for t in terms:
                    postings.setdefault(t, []).append(r["entry_id"])
        d = self.dialect
        manifest = {"schema": d.manifest_schema, "schema_version": max(d.manifest_versions), "archive_id": self.archive_id, "created_at": self.created_at, "dedup": self.dedup, "entry_count": len(entries), "raw_bytes": sum(e["size"] for e in entries), "entries": entries, "methods": methods, "search": {"index_schema": d.index_schema, "index_schema_version": max(d.index_versions), "default_mode": "lexical", "index_built": self.indexed}}
        index = {"schema": d.index_schema, "schema_version": max(d.index_versions), "archive_id": self.archive_id, "lexical": {"documents": documents, "postings": {t: sorted(ids) for t, ids in sorted(postings.items())}}}
        return manifest, index

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
