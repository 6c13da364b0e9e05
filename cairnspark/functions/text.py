"""Column expressions for text, paths and numbers.  All of them stay in the JVM."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT = 2048
WORD = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """Words in order: extracted first and lower-cased then, so that case folding can't split or join words."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1)), F.lower)


def terms(*texts: Column) -> Column:
    """Distinct words of all texts, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(tokens(t) for t in texts)))))


def excerpt(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, EXCERPT)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last ``.ext`` of the base name in lower case; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def ancestors(path: Column) -> Column:
    """Every proper directory prefix of a path, outermost first."""
    return F.when(F.size(parts(path)) > 1, F.transform(F.sequence(F.lit(1), F.size(parts(path)) - 1), lambda k: F.array_join(F.slice(parts(path), 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def numbered(prefix: str, number: Column) -> Column:
    """``prefix`` and the number, zero-padded to eight digits and longer where it must be."""
    return F.format_string(prefix + "%08d", number)


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def share(part: Column, whole: Column, places: int) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole, places))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, half to even; 0 when there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, 2))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern with ``*``, ``?`` and ``[..]``, for Java's dialect."""
    out = re.sub(r"\\Z|\\z", r"\\z", fnmatch.translate(pattern))
    return "^" + out.replace("(?s:", "(?s)(?:")


def archive_path_ok(path: Column) -> Column:
    """A relative, normalised path with forward slashes: no empty, ``.`` or ``..`` part, no drive, not blank."""
    return F.coalesce((F.trim(path) != "") & ~path.contains("\\") & ~path.rlike(r"^.:") & ~path.rlike(r"(^|/)(\.{1,2})?(/|$)"), F.lit(False))


def remote_path_ok(path: Column, ending: str) -> Column:
    """As archive paths, and without any colon, and with the archive's ending in either case."""
    return archive_path_ok(path) & ~path.contains(":") & F.lower(path).endswith(ending)
