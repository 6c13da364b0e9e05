"""Which codec, media type and safety class a path has."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Suffix classes and protected names that results depend on.
TEXT_SUFFIXES = (".txt", ".md", ".json", ".csv", ".log", ".py", ".xml", ".html", ".htm", ".yaml", ".yml", ".ini", ".cfg")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".avif", ".heic")
PACKED_SUFFIXES = (".zip", ".7z", ".gz", ".bz2", ".xz", ".rar", ".pdf", ".mp4", ".mov", ".mkv", ".webm", ".mp3", ".wav", ".flac", ".iso")
PROTECTED = (".git", "node_modules", "__pycache__", ".venv", "venv")
SYSTEM_ROOTS = ("etc", "usr", "var", "bin", "sbin", "boot", "proc", "sys")
LINK_TARGET_BYTES = 4096


def requested_method(path: Column) -> Column:
    ext = T.suffix(path)
    return F.when(ext.isin(*TEXT_SUFFIXES), "zstd").when(ext.isin(*IMAGE_SUFFIXES), "webp_or_store").otherwise("store")


def default_codec(path: Column) -> Column:
    return F.when(T.suffix(path).isin(*TEXT_SUFFIXES), "deflate").otherwise("store")


def searchable(path: Column, kind: Column | None = None, indexed: bool = True) -> Column:
    """Text suffix, index wanted, and a regular file."""
    wanted = T.suffix(path).isin(*TEXT_SUFFIXES) & F.lit(indexed)
    return wanted if kind is None else wanted & (kind == "file")


def policy_reason(path: Column) -> Column:
    ext = T.suffix(path)
    return F.when(ext.isin(*TEXT_SUFFIXES), "text").when(ext.isin(*IMAGE_SUFFIXES), "image").when(ext.isin(*PACKED_SUFFIXES), "packed").otherwise("unknown")


def media_type(path: Column) -> Column:
    """By suffix from the standard table of media types; anything else is an octet stream."""
    mimetypes.init()
    table = {k: v for k, v in mimetypes.types_map.items() if k in TEXT_SUFFIXES + IMAGE_SUFFIXES + PACKED_SUFFIXES}
    pairs = F.create_map(*(F.lit(x) for kv in sorted(table.items()) for x in kv))
    return F.coalesce(F.try_element_at(pairs, T.suffix(path)), F.lit("application/octet-stream"))


def has_protected_part(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, PROTECTED)))


def below_system_root(path: Column) -> Column:
    """Whether the outermost directory of an absolute path belongs to the system."""
    return F.lower(F.regexp_extract(path, r"^/+([^/]+)", 1)).isin(*SYSTEM_ROOTS)


def skip_reason(path: Column, kind: Column, target: Column, allow_system: bool = False) -> Column:
    """Why a walked path is left out, or null: protected, system, special, symlink-target."""
    out = F.when(has_protected_part(path), "protected")
    if not allow_system:
        out = out.when(below_system_root(path), "system")
    bad = target.isNull() | (target == "") | target.contains("\0") | (F.octet_length(target) > LINK_TARGET_BYTES)
    return out.when(~kind.isin("file", "dir", "symlink"), "special").when((kind == "symlink") & bad, "symlink-target")
