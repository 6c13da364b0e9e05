"""Object stores: one contract, a local one, a REST one with injected HTTP, and a stub that fails closed."""

from __future__ import annotations

import fnmatch
import json
import os
import shutil
import urllib.parse
import warnings
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .container import mapped, publish, safe_path

LISTING = "path string, size long, modified string, file_type string, file_id string"
MOST_FOUND, MOST_DEPTH, PAGE = 2000, 8, 1000


class StoreError(RuntimeError):
    """A store that refused or failed."""


class NotFoundError(StoreError):
    """Nothing at that path."""


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    modified: str | None
    file_type: str
    file_id: str | None = None


def free_backup(path: str, stamp: str | None = None) -> str:
    """Where what is at ``path`` is kept before it is replaced: a stamp of the time, and a number if that is taken."""
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    n = 0
    while os.path.lexists(name := f"{path}.backup-{stamp}{f'-{n}' if n else ''}"):
        n += 1
    return name


def back_up(path: str, stamp: str | None = None) -> str | None:
    """Copy the file at ``path`` beside it; None if nothing is there."""
    if not os.path.lexists(path):
        return None
    name = free_backup(path, stamp)
    shutil.copy2(path, name, follow_symlinks=False)
    return name


class ObjectStore(ABC):
    """What an archive job needs of a store.  Paths are relative, with forward slashes."""

    @abstractmethod
    def list_folder(self, path: str) -> list[FileInfo]: ...

    @abstractmethod
    def get_meta(self, path: str) -> FileInfo | None: ...

    @abstractmethod
    def ensure_folder(self, path: str) -> None: ...

    @abstractmethod
    def upload(self, source: str, path: str, overwrite: bool = False) -> FileInfo: ...

    @abstractmethod
    def download(self, path: str, target: str) -> None: ...

    @abstractmethod
    def delete(self, path: str) -> None: ...

    @abstractmethod
    def read_bytes(self, path: str) -> bytes: ...

    def read_range(self, path: str, offset: int, length: int) -> bytes:
        raise NotImplementedError

    def find(self, path: str, pattern: str, most: int | None = MOST_FOUND, depth: int | None = MOST_DEPTH) -> list[FileInfo]:
        """Files below a folder whose base name fits a shell pattern, breadth first.

        At most ``most`` items are looked at, in ``depth`` levels; where more are there, a warning says so.  None for
        either looks at all.
        """
        out, seen, cut, work = [], 0, False, deque([(path, 0)])
        while work:
            folder, level = work.popleft()
            for item in self.list_folder(folder):
                seen += 1
                if most is not None and seen > most:
                    warnings.warn(f"only {most} items below {path!r} were looked at", stacklevel=2)
                    return out
                if item.file_type == "dir":
                    if depth is None or level < depth:
                        work.append((item.path, level + 1))
                    else:
                        cut = True
                elif fnmatch.fnmatchcase(item.path.rsplit("/", 1)[-1], pattern):
                    out.append(item)
        if cut:
            warnings.warn(f"folders more than {depth} levels below {path!r} were not looked at", stacklevel=2)
        return out


def checked(path: str, root_allowed: bool = False) -> str:
    if root_allowed and path == "":
        return path
    if not safe_path(path):
        raise StoreError(f"path {path!r} leaves the store")
    return path


class LocalStore(ObjectStore):
    """A folder as a store."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def _at(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.root, checked(path, True)))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise StoreError(f"path {path!r} leaves the store")
        return full

    def _info(self, path: str) -> FileInfo:
        info = os.stat(self._at(path))
        kind = "dir" if os.path.isdir(self._at(path)) else "file"
        return FileInfo(path, info.st_size if kind == "file" else 0, datetime.fromtimestamp(info.st_mtime, UTC).isoformat(), kind)

    def list_folder(self, path: str) -> list[FileInfo]:
        full = self._at(path)
        return [self._info(f"{path}/{n}".lstrip("/")) for n in sorted(os.listdir(full))] if os.path.isdir(full) else []

    def get_meta(self, path: str) -> FileInfo | None:
        return self._info(path) if os.path.exists(self._at(path)) else None

    def ensure_folder(self, path: str) -> None:
        os.makedirs(self._at(path), exist_ok=True)

    def upload(self, source: str, path: str, overwrite: bool = False) -> FileInfo:
        full = self._at(path)
        if os.path.exists(full) and not overwrite:
            raise StoreError(f"{path} exists")
        back_up(full)

        def copy(out) -> None:
            with open(source, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)

        publish({full: copy})
        return self._info(path)

    def download(self, path: str, target: str) -> None:
        full = self._at(path)
        if not os.path.isfile(full):
            raise NotFoundError(path)
        back_up(target)

        def copy(out) -> None:
            with open(full, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)

        publish({target: copy})

    def delete(self, path: str) -> None:
        full = self._at(checked(path))
        shutil.rmtree(full) if os.path.isdir(full) else os.path.exists(full) and os.unlink(full)

    def read_bytes(self, path: str) -> bytes | memoryview:
        """Of a large file a view, which takes no memory."""
        if not os.path.isfile(self._at(path)):
            raise NotFoundError(path)
        return mapped(self._at(path), 0, os.path.getsize(self._at(path)))

    def read_range(self, path: str, offset: int, length: int) -> bytes | memoryview:
        if offset < 0 or length < 0:
            raise StoreError("a range begins at 0 or later and has no negative length")
        if not os.path.isfile(self._at(path)):
            raise NotFoundError(path)
        data = mapped(self._at(path), offset, length)
        if len(data) != length:
            raise StoreError(f"{path}: {len(data)} of {length} bytes")
        return data


@dataclass(frozen=True)
class Reply:
    status: int
    body: bytes = b""


Http = Callable[[str, str, dict, bytes | None], Reply]


class RestStore(ObjectStore):
    """A store behind a REST service; ``http(method, url, headers, body)`` is injected, and so can be replaced in tests.

    The token is taken from the caller and is never part of a message.
    """

    def __init__(self, base_url: str, http: Http, token: str | None = None, scheme: str = "disk:"):
        if not token:
            raise StoreError("no token is configured")
        self.base, self.http, self.scheme, self._token = base_url.rstrip("/"), http, scheme, token

    def _call(self, method: str, url: str, query: dict | None = None, headers: dict | None = None, body: bytes | None = None, missing_ok: bool = False) -> Reply | None:
        full = url if url.startswith("http") else f"{self.base}/{url}"
        if query:
            full += ("&" if "?" in full else "?") + urllib.parse.urlencode(query)
        reply = self.http(method, full, {"Authorization": f"OAuth {self._token}"} | (headers or {}), body)
        if reply.status == 404:
            if missing_ok:
                return None
            raise NotFoundError("nothing at that path")
        if reply.status in (401, 403):
            raise StoreError("the service refused the token" if reply.status == 401 else "the service forbids that")
        if reply.status >= 400:
            raise StoreError(f"the service answered {reply.status}")
        return reply

    @staticmethod
    def _json(reply: Reply) -> dict:
        try:
            value = json.loads(reply.body)
        except ValueError as error:
            raise StoreError("the service answered with no JSON") from error
        if not isinstance(value, dict):
            raise StoreError("the service answered with no object")
        return value

    def _info(self, item: dict) -> FileInfo:
        path = str(item.get("path", "")).removeprefix(self.scheme).strip("/")
        return FileInfo(path, int(item.get("size") or 0), item.get("modified"), "dir" if item.get("type") == "dir" else "file", item.get("resource_id"))

    def _place(self, path: str) -> dict:
        return {"path": f"{self.scheme}/{checked(path, True)}"}

    def list_folder(self, path: str) -> list[FileInfo]:
        """All items, page by page."""
        items, total = [], None
        while total is None or len(items) < total:
            query = self._place(path) | {"limit": PAGE} | ({"offset": len(items)} if items else {})
            reply = self._call("GET", "resources", query, missing_ok=True)
            inner = self._json(reply).get("_embedded", {}) if reply else {}
            page = inner.get("items", [])
            items += page
            total = inner.get("total", len(items)) if len(page) == PAGE or "total" in inner else len(items)
            if not page:
                break
        return sorted(map(self._info, items), key=lambda i: i.path)

    def get_meta(self, path: str) -> FileInfo | None:
        reply = self._call("GET", "resources", self._place(path), missing_ok=True)
        return self._info(self._json(reply)) if reply else None

    def ensure_folder(self, path: str) -> None:
        parts = checked(path).split("/")
        for k in range(len(parts)):
            at = "/".join(parts[: k + 1])
            if self.get_meta(at) is None:
                self._call("PUT", "resources", self._place(at))

    def upload(self, source: str, path: str, overwrite: bool = False) -> FileInfo:
        place = self._json(self._call("GET", "resources/upload", self._place(path) | {"overwrite": str(overwrite).lower()}))
        with open(source, "rb") as f:
            data = f.read()
        self._call("PUT", place["href"], body=data)
        found = self.get_meta(path)
        if found is None or found.size != len(data):
            raise StoreError(f"{path}: the upload is not whole")
        return found

    def _link(self, path: str) -> str:
        return self._json(self._call("GET", "resources/download", self._place(path)))["href"]

    def download(self, path: str, target: str) -> None:
        data = self.read_bytes(path)
        known = self.get_meta(path)
        if known is not None and known.size != len(data):
            raise StoreError(f"{path}: {len(data)} of {known.size} bytes")
        publish({target: lambda out: out.write(data)})

    def delete(self, path: str) -> None:
        self._call("DELETE", "resources", self._place(checked(path)) | {"permanently": "true"}, missing_ok=True)

    def read_bytes(self, path: str) -> bytes:
        return self._call("GET", self._link(path)).body

    def read_range(self, path: str, offset: int, length: int) -> bytes:
        """A service that ignores the range answers 200 with everything, which is cut here."""
        reply = self._call("GET", self._link(path), headers={"Range": f"bytes={offset}-{offset + length - 1}"})
        data = reply.body[offset : offset + length] if reply.status == 200 else reply.body
        if len(data) != length:
            raise StoreError(f"{path}: {len(data)} of {length} bytes")
        return data


class UnconfiguredStore(ObjectStore):
    """A provider that isn't set up: every call fails."""

    def _refuse(self, *_, **__):
        raise StoreError("this provider is not configured")

    list_folder = get_meta = ensure_folder = upload = download = delete = read_bytes = read_range = find = _refuse


def find_all(spark: SparkSession, store: ObjectStore, path: str, patterns: list[str]) -> DataFrame:
    """Paths of all files below a folder whose base name fits a shell pattern, level by level; tasks list the folders.

    Nothing is left out at any number of items or levels.  Only the folders of a level meet on the driver.
    """

    def run(batches):
        for batch in batches:
            items = [i for folder in batch.column("folder").to_pylist() for i in store.list_folder(folder)]
            kept = [i for i in items if i.file_type == "dir" or any(fnmatch.fnmatchcase(i.path.rsplit("/", 1)[-1], p) for p in patterns)]
            yield pa.RecordBatch.from_arrays([pa.array([i.path for i in kept], pa.string()), pa.array([i.file_type == "dir" for i in kept], pa.bool_())], ["path", "is_folder"])

    folders, out = [path], spark.createDataFrame([], "path string")
    while folders:
        rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism))
        found = rows.mapInArrow(run, "path string, is_folder boolean")
        out = out.unionByName(found.where("NOT is_folder").select("path"))
        folders = [r["path"] for r in found.where("is_folder").select("path").collect()]
    return out


def listing(spark: SparkSession, items: list[FileInfo]) -> DataFrame:
    """A listing as a table."""
    return spark.createDataFrame([(i.path, i.size, i.modified, i.file_type, i.file_id) for i in items], LISTING)
