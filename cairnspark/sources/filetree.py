"""A data source that walks file trees: every entry once, links not followed, skipped paths with their reason."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.policy import LINK_TARGET_BYTES, PROTECTED, SYSTEM_ROOTS

SCHEMA = "source string, path string, kind string, size long, mode int, mtime_ns long, target string, reason string, part long, nth long"


class TreeError(ValueError):
    """Inputs that give no catalogue."""


def skip_reason(path: str, allow_system: bool) -> str | None:
    parts = [p.lower() for p in path.split("/") if p]
    if any(p in PROTECTED for p in parts):
        return "protected"
    return "system" if not allow_system and parts and parts[0] in SYSTEM_ROOTS else None


def describe(source: str, path: str) -> tuple:
    """The row of one path; what went away meanwhile is a row with that reason."""
    try:
        info = os.lstat(source)
    except OSError:
        return (source, path, "file", None, None, None, None, "vanished")
    mode, mtime = stat.S_IMODE(info.st_mode), info.st_mtime_ns
    if stat.S_ISLNK(info.st_mode):
        target = os.readlink(source)
        raw = os.fsencode(target)
        bad = not raw or b"\0" in raw or len(raw) > LINK_TARGET_BYTES
        return (source, path, "symlink", 0, mode, mtime, target, "symlink-target" if bad else None)
    if stat.S_ISDIR(info.st_mode):
        return (source, path, "dir", 0, mode, mtime, None, None)
    return (source, path, "file", info.st_size, mode, mtime, None, None if stat.S_ISREG(info.st_mode) else "special")


def walk(source: str, path: str, allow_system: bool) -> Iterator[tuple]:
    """A path and all below it in the order of path components; a skipped directory is reported, not entered."""
    own = describe(source, path)
    parts = path.split("/")
    if own[-1] is None and any(p.lower() in PROTECTED for p in parts):
        own = (*own[:-1], "protected")
    yield own
    if own[2] == "dir" and own[-1] is None:
        for name in sorted(os.listdir(source)):
            yield from walk(os.path.join(source, name), f"{path}/{name}", allow_system)


@dataclass
class Subtrees(InputPartition):
    """Children of the root that a task walks; parts in their order are the walk in its order."""

    part: int
    items: list[tuple[str, str]]
    deep: bool


class FileTree(DataSource):
    """``spark.read.format("filetree").load(root)``; option ``allow_system`` admits system roots."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    #: Plain children of the root in one task at the most; a folder among them begins a task of its own.
    FILES = 256

    def __init__(self, options):
        self.root = options["path"].removeprefix("file:")
        self.allow_system = options.get("allow_system", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """The root itself, and its children in their order: a task for each folder, and for each stretch of files."""
        root = os.path.abspath(self.root)
        if not os.path.lexists(root):
            raise TreeError(f"no such input: {self.root}")
        if reason := skip_reason(os.path.realpath(root), self.allow_system):
            raise TreeError(f"{reason} path: {self.root}")
        name = os.path.basename(root)
        out = [Subtrees(0, [(root, name)], False)]
        if not os.path.isdir(root) or os.path.islink(root):
            return out
        for child in sorted(os.scandir(root), key=lambda e: e.name):
            folder = child.is_dir(follow_symlinks=False)
            if folder or out[-1].part == 0 or len(out[-1].items) >= self.FILES or os.path.isdir(out[-1].items[-1][0]):
                out.append(Subtrees(len(out), [], True))
            out[-1].items.append((child.path, f"{name}/{child.name}"))
        return out

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        nth = 0
        for source, path in partition.items:
            for row in walk(source, path, self.allow_system) if partition.deep else [describe(source, path)]:
                yield (*row, partition.part, nth)
                nth += 1
