"""The archive container: a fixed header, a manifest, an index, and chunks laid end to end.

Plain Python for metadata, shared by the data source, the writer and remote reads.  Payload never passes through here
whole: chunks are read by byte range in tasks and copied block by block.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import mmap
import operator
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

BLOCK = 1 << 20
HEADER_FIELDS = ("header_offset", "header_length", "manifest_offset", "manifest_length", "index_offset", "index_length", "data_offset", "data_length", "archive_size", "entry_count")
SHA = re.compile(r"[0-9a-f]{64}")


class FormatError(ValueError):
    """An archive, or a part of one, that breaks its format."""


@dataclass(frozen=True)
class Dialect:
    """Names and numbers that archives of one family share; set them to read archives of another family."""

    magic: bytes = b"CAIRN"
    header_size: int = 8192
    container: str = "cairn"
    versions: tuple[int, ...] = (1, 2)
    ending: str = ".cairn"
    manifest_schema: str = "cairn.manifest"
    manifest_versions: tuple[int, ...] = (1, 2)
    index_schema: str = "cairn.index"
    index_versions: tuple[int, ...] = (1, 2)


OWN = Dialect()


def canonical_json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8")


def pretty_json(value) -> bytes:
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode("utf-8")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def parse_json(data: bytes, what: str) -> dict:
    try:
        value = json.loads(str(data, "utf-8"))
    except (UnicodeDecodeError, json.JSONDecodeError) as error:
        raise FormatError(f"{what} is not JSON") from error
    if not isinstance(value, dict):
        raise FormatError(f"{what} is not an object")
    return value


def checked_header(header: dict, dialect: Dialect, file_size: int | None) -> dict:
    """The header, if its sections are of the right types and tile the file."""
    if header.get("container") != dialect.container or header.get("format_version") not in dialect.versions:
        raise FormatError("unknown container or version")
    n = {}
    for name in HEADER_FIELDS:
        value = header.get(name)
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise FormatError(f"header: {name}")
        n[name] = value
    at = len(dialect.magic)
    if (n["header_offset"], n["header_length"]) != (at, dialect.header_size):
        raise FormatError("header: its own place")
    at += dialect.header_size
    for part in ("manifest", "index", "data"):
        if n[f"{part}_offset"] != at or (part != "data" and n[f"{part}_length"] == 0):
            raise FormatError(f"header: place of the {part}")
        at += n[f"{part}_length"]
    if n["archive_size"] != at or (file_size is not None and file_size != at):
        raise FormatError("header: size of the archive")
    for name in ("manifest_sha256", "index_sha256"):
        if not isinstance(header.get(name), str) or not SHA.fullmatch(header[name]):
            raise FormatError(f"header: {name}")
    return header


def parse_header(data: bytes, dialect: Dialect = OWN, file_size: int | None = None) -> dict:
    """The header from the first bytes of an archive."""
    if len(data) < len(dialect.magic) + dialect.header_size or not data.startswith(dialect.magic):
        raise FormatError("no archive, or cut short")
    block = data[len(dialect.magic) : len(dialect.magic) + dialect.header_size]
    return checked_header(parse_json(block.rstrip(b" "), "header"), dialect, file_size)


def parse_section(data: bytes, header: dict, part: str) -> dict:
    if len(data) != header[f"{part}_length"] or sha256(data) != header[f"{part}_sha256"]:
        raise FormatError(f"{part}: checksum")
    return parse_json(data, part)


def index_parts(index: dict, dialect: Dialect = OWN) -> tuple[dict, dict]:
    """Documents and postings of an index of either version, checked against each other."""
    if index.get("schema") != dialect.index_schema or index.get("schema_version") not in dialect.index_versions:
        raise FormatError("index: schema")
    block = index.get("lexical") if index["schema_version"] > 1 else index
    if not isinstance(block, dict) or not isinstance(block.get("documents"), dict) or not isinstance(block.get("postings"), dict):
        raise FormatError("index: documents or postings")
    for key, document in block["documents"].items():
        if not isinstance(document, dict) or document.get("entry_id", key) != key:
            raise FormatError("index: document")
    for term, ids in block["postings"].items():
        if not isinstance(ids, list) or any(i not in block["documents"] for i in ids):
            raise FormatError(f"index: posting of {term!r}")
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            raise FormatError(f"index: posting of {term!r} isn't sorted, or names an entry twice")
    return block["documents"], block["postings"]


def checked_pair(header: dict, manifest: dict, index: dict, dialect: Dialect = OWN) -> None:
    """Manifest and index belong to the header and to each other."""
    if manifest.get("schema") != dialect.manifest_schema or manifest.get("schema_version") not in dialect.manifest_versions:
        raise FormatError("manifest: schema")
    entries = manifest.get("entries")
    if not isinstance(entries, list) or len(entries) != header["entry_count"]:
        raise FormatError("manifest: entries")
    if manifest.get("archive_id") != header.get("archive_id") or index.get("archive_id", header.get("archive_id")) != header.get("archive_id"):
        raise FormatError("archive ids differ")
    path_of = {}
    for e in entries:
        if wrong := entry_problem(e):
            raise FormatError(f"manifest: {wrong} of entry {e.get('entry_id') if isinstance(e, dict) else e!r}")
        if e["entry_id"] in path_of or e["chunk_offset"] + e["chunk_length"] > header["data_length"]:
            raise FormatError(f"manifest: entry {e['entry_id']!r}")
        path_of[e["entry_id"]] = e["path"]
    if len(set(path_of.values())) != len(path_of):
        raise FormatError("manifest: a path occurs twice")
    links = {e["path"] for e in entries if e.get("kind") == "symlink"}
    for path in path_of.values():
        if not safe_path(path) or links & {*_ancestors(path)}:
            raise FormatError(f"manifest: path {path!r}")
    search = manifest.get("search")
    for block, what in ((search.get("semantic") if isinstance(search, dict) else None, "manifest"), (index.get("semantic"), "index")):
        if wrong := semantic_problem(block):
            raise FormatError(f"{what}: semantic {wrong}")
    if isinstance(search, dict) and search.get("semantic") is not None and index.get("semantic") is not None and search["semantic"] != index["semantic"]:
        raise FormatError("the semantic blocks of manifest and index differ")
    for key, document in index_parts(index, dialect)[0].items():
        if path_of.get(key) != document.get("path"):
            raise FormatError(f"index: document {key!r} and its entry differ")


# What entries may hold.
KINDS = ("file", "symlink", "dir")
CODECS = ("store", "deflate", "zstd")
METRICS = ("cosine", "dot", "l2")
MOST_MODE = 0o7777


def whole(value) -> bool:
    """A whole number that is none of true and false."""
    return isinstance(value, int) and not isinstance(value, bool)


def valid_mode(value) -> bool:
    return whole(value) and 0 <= value <= MOST_MODE


def entry_problem(entry) -> str | None:
    """The first field of a manifest entry that isn't as the format has it.

    Kind, metadata and search fields came later, so entries may lack them.
    """
    if not isinstance(entry, dict):
        return "type"
    text = lambda v: isinstance(v, str) and bool(v)
    count = lambda v: whole(v) and v >= 0
    needed = {"entry_id": text, "path": text, "size": count, "sha256": lambda v: isinstance(v, str) and bool(SHA.fullmatch(v)), "codec": lambda v: v in CODECS, "chunk_offset": count, "chunk_length": count}
    for name, fine in needed.items():
        if name not in entry or not fine(entry[name]):
            return name
    may = {"kind": lambda v: v in KINDS, "mode": valid_mode, "mtime_ns": whole, "stored_size": count, "searchable": lambda v: isinstance(v, bool), "target": text, "dedup_of": text, "media_type": text, "requested_method": text, "chunk_id": text, "changing": lambda v: isinstance(v, bool)}
    for name, fine in may.items():
        if entry.get(name) is not None and not fine(entry[name]):
            return name
    kind = entry.get("kind") or "file"
    if (kind == "symlink") != (entry.get("target") is not None):
        return "target"
    if kind != "file" and (entry["size"] or entry.get("searchable")):
        return "size" if entry["size"] else "searchable"
    if entry.get("stored_size", entry["chunk_length"]) != entry["chunk_length"]:
        return "stored_size"
    return None


def semantic_problem(block) -> str | None:
    """What is wrong with a semantic descriptor; absent ones are fine."""
    if block is None:
        return None
    if not isinstance(block, dict) or block.get("status") not in ("ready", "unavailable"):
        return "status"
    if block.get("metric") is not None and block["metric"] not in METRICS:
        return "metric"
    if block["status"] == "ready":
        if not isinstance(block.get("model_id"), str) or not block["model_id"].strip():
            return "model_id"
        if not whole(block.get("dimensions")) or block["dimensions"] <= 0:
            return "dimensions"
    return None


def _ancestors(path: str) -> Iterator[str]:
    parts = path.split("/")
    return ("/".join(parts[:k]) for k in range(1, len(parts)))


def safe_path(path) -> bool:
    """Relative and normalised with forward slashes, without parts that climb or drives."""
    return isinstance(path, str) and bool(path.strip()) and "\\" not in path and path[1:2] != ":" and not any(p in ("", ".", "..") for p in path.split("/"))


Range = Callable[[int, int], bytes]


def read_metadata(read: Range, dialect: Dialect = OWN, file_size: int | None = None) -> tuple[dict, dict, dict]:
    """Header, manifest and index by exactly three range reads; payload is not touched."""
    header = parse_header(read(0, len(dialect.magic) + dialect.header_size), dialect, file_size)
    manifest = parse_section(read(header["manifest_offset"], header["manifest_length"]), header, "manifest")
    index = parse_section(read(header["index_offset"], header["index_length"]), header, "index")
    checked_pair(header, manifest, index, dialect)
    return header, manifest, index


def mapped(path: str, offset: int, length: int) -> bytes | memoryview:
    """Bytes of a file, as many as there are: read if they are few, else a view of the mapped file, which is not copied to memory."""
    with open(path, "rb") as f:
        length = max(0, min(length, os.fstat(f.fileno()).st_size - offset))
        if length > BLOCK:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))[offset : offset + length]
        f.seek(offset)
        return f.read(length)


def file_range(path: str) -> Range:
    def read(offset: int, length: int) -> bytes | memoryview:
        data = mapped(path, offset, length)
        if len(data) != length:
            raise FormatError(f"{path}: {len(data)} of {length} bytes at {offset}")
        return data

    return read


def read_archive(path: str, dialect: Dialect = OWN) -> tuple[dict, dict, dict]:
    return read_metadata(file_range(path), dialect, os.path.getsize(path))


class Json:
    """JSON that is taken part by part from a buffer, of which only some is text at a time."""

    SPACE, DECODER = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()

    def __init__(self, data: bytes | memoryview, what: str):
        self.data, self.what, self.fed, self.base, self.text, self.pos = memoryview(data), what, 0, 0, "", 0
        self.decoder = codecs.getincrementaldecoder("utf-8")()

    def wrong(self) -> FormatError:
        return FormatError(f"{self.what} is not JSON")

    def at(self) -> int:
        """The byte that comes next."""
        return self.base + len(self.text[: self.pos].encode())

    def more(self) -> bool:
        if self.fed >= len(self.data):
            return False
        block = self.data[self.fed : self.fed + max(BLOCK, len(self.text) - self.pos)]
        self.fed += len(block)
        self.base = self.at()
        try:
            self.text, self.pos = self.text[self.pos :] + self.decoder.decode(block, self.fed >= len(self.data)), 0
        except UnicodeDecodeError as error:
            raise self.wrong() from error
        return True

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            self.pos = self.SPACE.match(self.text, self.pos).end()
            if self.pos < len(self.text):
                return self.text[self.pos]
            if not self.more():
                return ""

    def take(self, characters: str) -> str:
        c = self.peek()
        if not c or c not in characters:
            raise self.wrong()
        self.pos += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                value, end = self.DECODER.raw_decode(self.text, self.pos)
            except (json.JSONDecodeError, RecursionError) as error:
                if not self.more():
                    raise self.wrong() from error
                continue
            if end < len(self.text) or not self.more():  # a number at the end of the text may go on
                self.pos = end
                return value

    def items(self, *cutters: Cutter) -> Iterator:
        """Elements of an array, or key and value pairs of an object; cutters note the places of blocks of them."""
        close = {"[": "]", "{": "}"}[self.take("[{")]
        known: str | None = None
        if self.peek() == close:
            self.pos += 1
            return
        while True:
            self.peek()
            for c in cutters:
                c.begin(self)
            if close == "]":
                yield self.value()
            else:
                known = self.key()
                yield known, self.value()
            last = self.peek() == close
            for c in cutters:
                c.end(self, known, last)
            if self.take("," + close) == close:
                return

    def key(self) -> str:
        if self.peek() != '"':
            raise self.wrong()
        key = self.value()
        self.take(":")
        return key

    def members(self) -> Iterator[str]:
        """Keys of an object, none twice; the value of each is to be taken before the next key."""
        self.take("{")
        if self.peek() == "}":
            self.pos += 1
            return
        seen = set()
        while True:
            key = self.key()
            if key in seen:
                raise FormatError(f"{self.what}: {key!r} occurs twice")
            seen.add(key)
            yield key
            if self.take(",}") == "}":
                return


@dataclass(frozen=True)
class Block:
    """Elements of a section that lie together: their bytes, the number of the first, and the least and greatest key."""

    offset: int
    length: int
    first: int
    least: str = ""
    greatest: str = ""


@dataclass
class Cutter:
    """Cuts elements into blocks of bounded rows, bytes of JSON and weight."""

    rows: int
    most: int = 1 << 62
    json: int = 4 * BLOCK
    blocks: list[Block] = field(default_factory=list)
    weight: int = 0
    _n: int = 0
    _open: tuple[int, int] | None = None
    _keys: tuple[str, str] | None = None

    def begin(self, source: Json) -> None:
        if self._open is None:
            self._open, self.weight, self._keys = (source.at(), self._n), 0, None

    def end(self, source: Json, key: str | None, last: bool) -> None:
        self._n += 1
        if key is not None:
            self._keys = (min(self._keys[0], key), max(self._keys[1], key)) if self._keys else (key, key)
        if last or self._n - self._open[1] >= self.rows or self.weight >= self.most or source.base + source.pos - self._open[0] >= self.json:
            self.blocks.append(Block(self._open[0], source.at() - self._open[0], self._open[1], *(self._keys or ())))
            self._open = None


class Digests:
    """128-bit digests of texts, 16 bytes each."""

    def __init__(self):
        self.data = bytearray()

    def add(self, text: str) -> None:
        self.data += hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def sorted(self) -> np.ndarray:
        rows = np.frombuffer(bytes(self.data), "<u8").reshape(-1, 2)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def repeated(self) -> bool:
        rows = self.sorted()
        return bool((rows[1:] == rows[:-1]).all(axis=1).any())

    def missing(self, other: Digests) -> bool:
        """Whether some of these aren't among others, which are distinct."""
        both = Digests()
        mine = np.unique(self.sorted(), axis=0) if self.data else np.empty((0, 2), "<u8")
        both.data += mine.tobytes() + other.data
        rows = both.sorted()
        return int((rows[1:] == rows[:-1]).all(axis=1).sum()) < len(mine)


@dataclass
class Scan:
    """What opening an archive gives without keeping its entries or its index: the rest, totals, and places of blocks.

    Places count from the beginning of the section.  ``header`` is None where there are only sidecars.
    """

    header: dict | None
    manifest: dict
    index: dict
    blocks: dict[str, list[Block]]
    codecs: dict[str, int]
    documents: int = 0


def scan(manifest_data: bytes | memoryview, index_data: bytes | memoryview, header: dict | None, dialect: Dialect = OWN, rows: int = 20_000, on_entry: Callable[[int, dict], None] | None = None, on_document: Callable[[str, dict], None] | None = None) -> Scan:
    """The checks of ``checked_pair`` in one pass over both sections, of which no more than a block is kept.

    Of entries there remain digests, of documents their ids.
    """
    cut = {n: Cutter(rows) for n in ("entries", "documents", "postings")} | {"payload": Cutter(rows, 16 * BLOCK)}
    ids, paths, pairs, named = Digests(), Digests(), Digests(), Digests()
    links: set[str] = set()
    codecs_of: dict[str, int] = {}
    manifest, source = {}, Json(manifest_data, "manifest")
    count = end = 0
    if source.peek() != "{":
        raise FormatError("manifest is not an object")
    for name in source.members():
        if name != "entries":
            manifest[name] = source.value()
            continue
        if source.peek() != "[":
            raise FormatError("manifest: entries")
        manifest[name] = None
        for e in source.items(cut["entries"], cut["payload"]):
            if wrong := entry_problem(e):
                raise FormatError(f"manifest: {wrong} of entry {e.get('entry_id') if isinstance(e, dict) else e!r}")
            end = max(end, e["chunk_offset"] + e["chunk_length"])
            if header is not None and end > header["data_length"]:
                raise FormatError(f"manifest: entry {e['entry_id']!r}")
            if not safe_path(e["path"]):
                raise FormatError(f"manifest: path {e['path']!r}")
            if e.get("kind") == "symlink":
                links.add(e["path"])
            ids.add(e["entry_id"])
            paths.add(e["path"])
            pairs.add(json.dumps([e["entry_id"], e["path"]]))
            codecs_of[e["codec"]] = codecs_of.get(e["codec"], 0) + 1
            cut["payload"].weight += e["size"] if e.get("kind", "file") == "file" else 0
            if on_entry:
                on_entry(count, e)
            count += 1
    if source.peek():
        raise source.wrong()
    if manifest.get("schema") != dialect.manifest_schema or manifest.get("schema_version") not in dialect.manifest_versions:
        raise FormatError("manifest: schema")
    own = header or {"archive_id": manifest.get("archive_id"), "entry_count": manifest.get("entry_count")}
    if "entries" not in manifest or count != own["entry_count"]:
        raise FormatError("manifest: entries")
    del manifest["entries"]
    if ids.repeated():
        raise FormatError("manifest: an entry id occurs twice")
    if paths.repeated():
        raise FormatError("manifest: a path occurs twice")
    if links:  # the paths are gone, so entries are read again
        for block in cut["entries"].blocks:
            for e in block_of(manifest_data, block, "manifest"):
                if links & {*_ancestors(e["path"])}:
                    raise FormatError(f"manifest: path {e['path']!r}")

    index, found, source = {}, {"documents": 0, "postings": 0}, Json(index_data, "index")
    known: set[str] = set()
    late = []

    def parts(where: str) -> Iterator[str]:
        """Takes documents and postings where they are, and gives other keys."""
        for name in source.members():
            if name not in ("documents", "postings"):
                yield name
                continue
            if source.peek() != "{":
                raise FormatError("index: documents or postings")
            places.setdefault(name, set()).add(where)
            n = 0
            for key, value in source.items(cut[name]) if places[name] == {where} else source.items():
                n += 1
                if name == "documents":
                    if not isinstance(value, dict) or value.get("entry_id", key) != key:
                        raise FormatError("index: document")
                    known.add(key)
                    named.add(json.dumps([key, value.get("path")]))
                    if on_document:
                        on_document(key, value)
                else:
                    if not isinstance(value, list):
                        raise FormatError(f"index: posting of {key!r}")
                    if not all(isinstance(i, str) for i in value):
                        raise FormatError(f"index: posting of {key!r}")
                    if not all(map(operator.lt, value, value[1:])):
                        raise FormatError(f"index: posting of {key!r} isn't sorted, or names an entry twice")
                    if "documents" not in places:
                        late.append((key, value))  # documents come first in what this package writes
                    elif not known.issuperset(value):
                        raise FormatError(f"index: posting of {key!r}")
            found[name] = n

    places: dict[str, set[str]] = {}
    if source.peek() != "{":
        raise FormatError("index is not an object")
    for name in parts("root"):
        if name == "lexical" and source.peek() == "{":
            for _ in parts("lexical"):
                source.value()
        else:
            index[name] = source.value()
    if source.peek():
        raise source.wrong()
    if index.get("schema") != dialect.index_schema or index.get("schema_version") not in dialect.index_versions:
        raise FormatError("index: schema")
    where = "lexical" if index["schema_version"] > 1 else "root"
    if places != {"documents": {where}, "postings": {where}}:
        raise FormatError("index: documents or postings")
    for key, value in late:
        if not known.issuperset(value):
            raise FormatError(f"index: posting of {key!r}")
    if len(known) != found["documents"]:
        raise FormatError("index: a document occurs twice")
    if manifest.get("archive_id") != own.get("archive_id") or index.get("archive_id", own.get("archive_id")) != own.get("archive_id"):
        raise FormatError("archive ids differ")
    search = manifest.get("search")
    for block, what in ((search.get("semantic") if isinstance(search, dict) else None, "manifest"), (index.get("semantic"), "index")):
        if wrong := semantic_problem(block):
            raise FormatError(f"{what}: semantic {wrong}")
    if isinstance(search, dict) and search.get("semantic") is not None and index.get("semantic") is not None and search["semantic"] != index["semantic"]:
        raise FormatError("the semantic blocks of manifest and index differ")
    if named.missing(pairs):
        raise FormatError("index: a document and its entry differ")
    return Scan(header, manifest, index, {n: c.blocks for n, c in cut.items()}, codecs_of, found["documents"])


def block_of(data: bytes | memoryview, block: Block, what: str, keyed: bool = False):
    """The elements of a block of a section."""
    text = str(data[block.offset : block.offset + block.length], "utf-8")
    return json.loads("{" + text + "}") if keyed else json.loads("[" + text + "]")


def scan_ranges(read: Range, dialect: Dialect = OWN, file_size: int | None = None, **options) -> Scan:
    """``read_metadata`` without what grows with the archive: three range reads, all checks."""
    header = parse_header(read(0, len(dialect.magic) + dialect.header_size), dialect, file_size)
    data = {}
    for part in ("manifest", "index"):
        data[part] = read(header[f"{part}_offset"], header[f"{part}_length"])
        if len(data[part]) != header[f"{part}_length"] or sha256(data[part]) != header[f"{part}_sha256"]:
            raise FormatError(f"{part}: checksum")
    return scan(data["manifest"], data["index"], header, dialect, **options)


_SCANS: dict[tuple, Scan] = {}


def scan_archive(path: str, dialect: Dialect = OWN, rows: int = 20_000) -> Scan:
    """The scan of a local archive; of a file that is the same as before it is kept."""
    info = os.stat(path)
    key = (os.path.realpath(path), info.st_ino, info.st_size, info.st_mtime_ns, info.st_ctime_ns, dialect, rows)
    if key not in _SCANS:
        while len(_SCANS) >= 8:
            del _SCANS[next(iter(_SCANS))]
        _SCANS[key] = scan_ranges(file_range(path), dialect, info.st_size, rows=rows)
    return _SCANS[key]


def header_of(manifest: dict, manifest_bytes: bytes, index_bytes: bytes, data_length: int, created_at: str, dialect: Dialect = OWN) -> dict:
    kinds = {e.get("kind", "file") for e in manifest["entries"]}
    return header_for(manifest["archive_id"], len(manifest["entries"]), kinds <= {"file"}, {"manifest": (len(manifest_bytes), sha256(manifest_bytes)), "index": (len(index_bytes), sha256(index_bytes))}, data_length, created_at, dialect)


def header_for(archive_id: str, entry_count: int, files_only: bool, sections: dict[str, tuple[int, str]], data_length: int, created_at: str, dialect: Dialect = OWN) -> dict:
    at = len(dialect.magic) + dialect.header_size
    header = {"container": dialect.container, "format_version": 1 if files_only else 2, "created_at": created_at, "archive_id": archive_id, "header_offset": len(dialect.magic), "header_length": dialect.header_size, "entry_count": entry_count}
    for part, size in (*((p, n) for p, (n, _) in sections.items()), ("data", data_length)):
        header |= {f"{part}_offset": at, f"{part}_length": size}
        at += size
    return header | {f"{p}_sha256": sha for p, (_, sha) in sections.items()} | {"archive_size": at}


def write_archive(path: str, manifest: dict, index: dict, chunks: Iterable[str], created_at: str, dialect: Dialect = OWN, sidecars: bool = True) -> dict:
    """Write an archive from staged chunk files, in the order of the manifest's chunks; returns its header.

    The archive and its sidecars appear together or not at all: each is written beside its place and then moved,
    and a failed move puts back what was there.
    """
    lengths: dict[str, tuple[int, int]] = {e["chunk_id"]: (e["chunk_offset"], e["chunk_length"]) for e in manifest["entries"]}
    data_length = sum(length for _, length in lengths.values())
    m, i = canonical_json(manifest), canonical_json(index)
    header = header_of(manifest, m, i, data_length, created_at, dialect)
    checked_header(header, dialect, None)
    checked_pair(header, manifest, index, dialect)
    block = canonical_json(header)
    if len(block) > dialect.header_size:
        raise FormatError("the header is too long")

    def body(out) -> None:
        out.write(dialect.magic + block.ljust(dialect.header_size) + m + i)
        written = 0
        for chunk in chunks:
            with open(chunk, "rb") as f:
                while data := f.read(BLOCK):
                    out.write(data)
                    written += len(data)
        if written != data_length:
            raise FormatError(f"chunks changed while copied: {written} of {data_length} bytes")

    targets = {path: body}
    if sidecars:
        targets |= {f"{path}.manifest.json": lambda out: out.write(pretty_json(manifest)), f"{path}.index.json": lambda out: out.write(pretty_json(index))}
    publish(targets)
    return header


def flat(value, pad: int) -> str:
    """``json.dumps`` with an indent of 2, of a list or dict without lists or dicts in it, at a depth of ``pad`` spaces."""
    if not value:
        return json.dumps(value)
    between = "\n" + " " * (pad + 2)
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=("," + between, ": "))
    return text[0] + between + text[1:-1] + "\n" + " " * pad + text[-1]


def write_pretty(data: bytes | memoryview, part: str, out) -> None:
    """``pretty_json`` of a canonical section, element by element."""

    def members(source: Json, pad: int) -> None:
        names = source.members()
        for k, name in enumerate(names):
            out.write((("{\n" if k == 0 else ",\n") + " " * (pad + 2) + json.dumps(name, ensure_ascii=False) + ": ").encode())
            if name == "lexical":
                members(source, pad + 2)
            elif name in ("entries", "documents", "postings") and source.peek() in ("[", "{"):
                elements(source, pad + 2)
            else:
                out.write(json.dumps(source.value(), ensure_ascii=False, sort_keys=True, indent=2).replace("\n", "\n" + " " * (pad + 2)).encode())
        out.write(("\n" + " " * pad + "}").encode())

    def elements(source: Json, pad: int) -> None:
        ends = {"[": "[]", "{": "{}"}[source.peek()]
        n = 0
        for n, e in enumerate(source.items(), 1):
            head = ""
            if ends == "{}":
                head, e = json.dumps(e[0], ensure_ascii=False) + ": ", e[1]
            nested = isinstance(e, dict) and any(isinstance(v, (list, dict)) for v in e.values())
            if nested and list(e)[-1] == "terms" and isinstance(e["terms"], list):  # a document
                text = flat({k: v for k, v in e.items() if k != "terms"}, pad + 2)[: -pad - 4] + ",\n" + " " * (pad + 4) + '"terms": ' + flat(e["terms"], pad + 4) + "\n" + " " * (pad + 2) + "}"
            elif nested or not isinstance(e, (list, dict)):
                text = json.dumps(e, ensure_ascii=False, sort_keys=True, indent=2).replace("\n", "\n" + " " * (pad + 2))
            else:
                text = flat(e, pad + 2)
            out.write(((ends[0] if n == 1 else ",") + "\n" + " " * (pad + 2) + head + text).encode())
        out.write(("\n" + " " * pad + ends[1] if n else ends).encode())

    members(Json(data, part), 0)
    out.write(b"\n")


def sidecar_writers(path: str, archive: Callable[[], str], dialect: Dialect = OWN) -> dict[str, Callable]:
    """For ``publish``: sidecars of an archive at ``path``, made from the file that ``archive`` names."""

    def writer(part: str) -> Callable:
        def write(out) -> None:
            read = file_range(archive())
            header = parse_header(read(0, len(dialect.magic) + dialect.header_size), dialect)
            write_pretty(read(header[f"{part}_offset"], header[f"{part}_length"]), part, out)

        return write

    return {f"{path}.{part}.json": writer(part) for part in ("manifest", "index")}


def write_sidecars(path: str, dialect: Dialect = OWN) -> None:
    """Put an archive's sidecars beside it."""
    scan_archive(path, dialect)
    publish(sidecar_writers(path, lambda: path, dialect))


def publish(targets: dict[str, Callable]) -> None:
    """Write every target beside its place, then move all; on failure the earlier files are back."""
    staged: dict[str, str] = {}
    backups: dict[str, str | None] = {}
    try:
        for path, write in targets.items():
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            fd, staged[path] = tempfile.mkstemp(prefix=".stage-", dir=os.path.dirname(os.path.abspath(path)))
            os.close(fd)
            with open(staged[path], "wb") as out:
                write(out)
                out.flush()
                os.fsync(out.fileno())
        for path, temp in staged.items():
            backups[path] = None
            if os.path.exists(path):
                backups[path] = temp + ".old"
                os.replace(path, backups[path])
            os.replace(temp, path)
    except BaseException:
        for path, old in backups.items():
            if old is not None and os.path.exists(old):
                os.replace(old, path)
            elif old is None and os.path.exists(path) and not os.path.exists(staged[path]):
                os.unlink(path)
        raise
    finally:
        for temp in staged.values():
            for left in (temp, temp + ".old"):
                if os.path.exists(left):
                    os.unlink(left)
