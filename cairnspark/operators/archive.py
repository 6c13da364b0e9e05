"""Packing a file tree into an archive, and restoring one, as Spark jobs."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as T
from ..sources import assembly, bundle, container, filetree, logs, planned
from ..sources.store import back_up
from . import codec, manifest


class GuardError(ValueError):
    """A job that would lose data or leave its folder."""


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the archive source answers terms itself
    spark.dataSource.register(bundle.Bundle)
    spark.dataSource.register(filetree.FileTree)


def walked(spark: SparkSession, root: str, allow_system: bool = False) -> tuple[DataFrame, DataFrame]:
    """Kept entries with their position in walk order, and skipped paths.

    Positions are given before anything is dropped, so the ids of kept entries have gaps where paths were skipped.
    The order is that of path components, in which each task walks its part of the tree; a position is a row's place
    in its part behind the rows of the parts before it, so only the sizes of the parts are summed in one task.
    """
    rows = planned.table(spark, filetree.TreeReader({"path": root, "allow_system": str(allow_system)}), filetree.SCHEMA)
    before =Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(parts, "part").withColumn("position", F.col("_before") + F.col("nth")).drop("_before", "part", "nth")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("path", "reason")


def walked_all(spark: SparkSession, roots: list[str], allow_system: bool = False) -> tuple[DataFrame, DataFrame]:
    """The trees of several inputs, one behind the other; an archive path that two of them would have is an error."""
    names = [os.path.basename(os.path.abspath(r)) for r in roots]
    if len({*names}) < len(names):
        raise GuardError(f"two inputs are named {max(names, key=names.count)!r}")
    kept = skipped = None
    for root in roots:
        rows, left = walked(spark, root, allow_system)
        if kept is None:
            kept, skipped = rows, left
            continue
        after = kept.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("_after"))
        kept = kept.unionByName(rows.join(F.broadcast(after)).withColumn("position", F.col("position") + F.col("_after")).drop("_after"))
        skipped = skipped.unionByName(left)
    if kept is None or kept.isEmpty():
        raise GuardError("nothing to pack")
    return kept, skipped


def contents(rows: DataFrame, accept_changing: bool = False) -> DataFrame:
    """``rows`` with content and changed; a file is read in a task and stated before and after.

    A file that went away has null content.  Directories and links have empty content.
    """
    kept = [c for c in rows.columns if c != "content"]
    types = dict(rows.dtypes)

    def load(kind: str, source: str) -> tuple[bytes | None, bool]:
        if kind != "file":
            return b"", False
        try:
            before = os.stat(source)
            with open(source, "rb") as f:
                data = f.read()
            after = os.stat(source)
        except OSError:
            return None, False
        return data, (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or len(data) != after.st_size

    def run(batches):
        for batch in batches:
            got = [load(k, s) for k, s in zip(batch.column("kind").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([d for d, _ in got], pa.binary()), pa.array([c for _, c in got], pa.bool_())], [*kept, "content", "changed"])

    out = rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), "content binary, changed boolean"]))
    return out if accept_changing else out.withColumn("content", F.when(~F.col("changed"), F.col("content")))


def inside(path: str, folder: str) -> bool:
    """Whether a path lies in a folder, once links are followed."""
    return os.path.realpath(path).startswith(os.path.realpath(folder) + os.sep)


def size_warnings(raw_bytes: int, packed_bytes: int | None, most_bytes: int | None) -> list[str]:
    """What is to be said of an archive's sizes: over the limit before or after packing, or no smaller than its input."""
    out = []
    if most_bytes is not None and raw_bytes > most_bytes:
        out.append(f"the input has {raw_bytes} bytes, over the limit of {most_bytes}")
    if packed_bytes is not None and most_bytes is not None and packed_bytes > most_bytes:
        out.append(f"the archive has {packed_bytes} bytes, over the limit of {most_bytes}")
    if packed_bytes is not None and packed_bytes > raw_bytes:
        out.append(f"the archive is {packed_bytes - raw_bytes} bytes larger than its input")
    return out


@dataclass
class Packed:
    """What packing did; ``changing`` counts files that changed while they were read."""

    skipped: DataFrame
    record: dict
    warnings: list[str]
    changing: int
    backup: str | None


def pack_all(spark: SparkSession, roots: list[str], archive: str, created_at: str = "", dedup: bool = True, indexed: bool = True, allow_system: bool = False, overwrite: bool = False, archive_id: str | None = None, accept_changing: bool = False, most_bytes: int | None = None, force: bool = False, on_record: Callable[[dict], None] | None = None, log: str | None = None, project: str | None = None, sidecars: bool = True) -> Packed:
    """Write an archive of trees.  Each distinct payload is compressed once, and no content is kept between passes.

    A first pass over the files gives sizes and digests, a second one payloads; a file whose digest is another by
    then ends the job.  Input over ``most_bytes`` is refused unless ``force``.  An archive that is overwritten has a
    backup first.  The savings record goes to ``on_record`` and is appended to ``log``.
    """
    if any(inside(archive, root) for root in roots):
        raise GuardError("the archive would lie inside its own input")
    if os.path.lexists(archive) and not overwrite:
        raise GuardError(f"{archive} exists")
    rows, skipped = walked_all(spark, roots, allow_system)
    read = contents(rows, accept_changing).withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256), "lost": F.col("content").isNull()}).drop("content").cache()  # metadata only
    layout = None
    try:
        totals = read.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("raw"), F.count_if("changed").alias("changing"), F.count_if(~F.col("lost")).alias("kept")).first()
        if not force and (over := size_warnings(totals["raw"], None, most_bytes)):
            raise GuardError(over[0])
        lost = read.where("lost").select("path", F.when(F.col("changed"), "changed").otherwise("vanished").alias("reason"))
        full = read.where("NOT lost")
        entries = manifest.entries(full, indexed).join(full.select("position", "source", "mode", "mtime_ns", "target"), "position")
        layout = manifest.chunk_layout(entries, dedup).cache()  # metadata only

        def prepare(rows: DataFrame) -> DataFrame:
            again = contents(rows, accept_changing=True)
            same = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat("path", F.lit(" changed while it was packed"))))
            again = again.withColumn("content", same)
            words = F.make_valid_utf8(F.col("content").cast("string"))
            text = F.when(F.col("searchable"), words)
            again = again.withColumns({"excerpt": T.excerpt(text), "terms": F.when(F.col("searchable"), T.terms(F.col("path"), text)), "owns": F.col("dedup_of").isNull()})
            names = ("position", "entry_id", "path", "chunk_id", "searchable", "requested_method", "codec", "excerpt", "terms", "owns")
            again = codec.compress(again.withColumn("content", F.when(F.col("owns"), F.col("content"))).select(*names, "content"))
            return again.withColumns({c: F.when(F.col("owns"), F.col(c)) for c in ("codec", "payload")})

        backup = back_up(archive)
        assembly.write(layout, prepare, totals["kept"], totals["raw"], archive, created_at, archive_id, indexed, dedup, overwrite, sidecars)
        gone = skipped.unionByName(lost)
        register(spark)
        found = container.scan_archive(archive)
        document, header = found.manifest, found.header
        raw, packed = document["raw_bytes"], header["archive_size"]
        record = {"operation": "pack", "archive": os.path.basename(archive), "disk": "local", "project": project, "raw_bytes": raw, "packed_bytes": packed, "saved_bytes": raw - packed, "saved_pct": round((raw - packed) / raw * 100, 2) if raw else 0.0, "methods": document["methods"]}
        if on_record:
            on_record(record)
        if log:
            logs.append(spark.createDataFrame([record], logs.SAVINGS), log)
        out = spark.createDataFrame([tuple(r) for r in gone.collect()], "path string, reason string")
        return Packed(out, record, size_warnings(raw, packed, most_bytes), totals["changing"], backup)
    finally:
        read.unpersist()
        if layout is not None:
            layout.unpersist()


def pack(spark: SparkSession, root: str, archive: str, **options) -> DataFrame:
    """Write an archive of one tree; returns the skipped paths."""
    return pack_all(spark, [root], archive, **options).skipped


def section(spark: SparkSession, archive: str, name: str, terms: list[str] | None = None) -> DataFrame:
    """A section as the archive source gives it; of postings only some terms, where they are named, from their blocks alone."""
    if name not in bundle.SCHEMAS:
        raise container.FormatError(f"no section {name!r}")
    reader = bundle.BundleReader({"path": archive, "section": name})
    reader.terms = None if terms is None else {*terms}
    return planned.table(spark, reader, bundle.SCHEMAS[name])


def restore_plan(spark: SparkSession, archive: str) -> DataFrame:
    """Entries in the order in which they are restored: files, then links, then directories from the deepest up."""
    step = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "symlink", 1).otherwise(2)
    return section(spark, archive, "entries").select("path", "kind", "size", "codec", step.alias("step"), F.size(F.split("path", "/")).alias("depth")).orderBy("step", F.desc("depth"), F.split("path", "/"))


def restore(spark: SparkSession, archive: str, folder: str, apply: bool = False, metadata: bool = True, allow_system: bool = False) -> list[str]:
    """Restore an archive into a folder that doesn't exist yet; without ``apply`` nothing is written.

    An archive that is reached by a link, and a target below a protected or system path, are refused.
    Returns warnings.  Tasks decode, verify and write files into a staging folder beside the target; links come after
    all files, directory times last; then the folder is moved into place.
    """
    if os.path.islink(archive):
        raise GuardError(f"{archive} is a link")
    if reason := filetree.skip_reason(os.path.realpath(folder), allow_system):
        raise GuardError(f"{reason} path: {folder}")
    header = container.scan_archive(archive).header
    if os.path.lexists(folder):
        raise GuardError(f"{folder} exists")
    if not apply:
        return []
    staging = f"{os.path.abspath(folder)}.staging-{uuid.uuid4().hex}"
    entries = section(spark, archive, "entries").withColumn("kind", F.coalesce("kind", F.lit("file")))
    start = header["data_offset"]

    def done(kind: str, make: Callable[[dict], list[str]]) -> tuple[int, list[str]]:
        """Make the entries of a kind in tasks; how many there are, and warnings."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = [w for row in batch.to_pylist() for w in make(row)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([said], pa.list_(pa.string()))], ["n", "warnings"])

        rows = entries.where(F.col("kind") == kind).select("path", "kind", "target", "mode", "mtime_ns", (F.col("chunk_offset") + start).alias("at"), F.col("chunk_length").alias("n"), "codec", "size", "sha256")
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, header["entry_count"] // 5_000)) if kind == "file" else rows
        got = rows.mapInArrow(run, "n long, warnings array<string>").collect()
        return sum(r["n"] for r in got), [w for r in got for w in r["warnings"]]

    def folder_of(row: dict) -> list[str]:
        os.makedirs(f"{staging}/{row['path']}", exist_ok=True)
        return []

    def file_of(row: dict) -> list[str]:
        target, digest = f"{staging}/{row['path']}", hashlib.sha256()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temp = f"{target}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            for block in bundle.decoded(archive, row["at"], row["n"], row["codec"], row["size"]):
                digest.update(block)
                f.write(block)
        if digest.hexdigest() != row["sha256"]:
            raise container.FormatError(f"{row['path']}: digest")
        os.replace(temp, target)
        return apply_metadata(target, row) if metadata else []

    def link_of(row: dict) -> list[str]:
        target = f"{staging}/{row['path']}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if not os.path.islink(target):  # a task that is run again
            os.symlink(row["target"], target)
        return apply_metadata(target, row) if metadata else []

    try:
        os.makedirs(staging)
        made = [done(kind, make) for kind, make in (("dir", folder_of), ("file", file_of), ("symlink", link_of))]
        if sum(n for n, _ in made) != header["entry_count"]:
            raise container.FormatError("not all entries were restored")
        warnings = [w for _, said in made for w in said]
        if metadata:
            folders = entries.where("kind = 'dir'").select("path", "kind", "mode", "mtime_ns").orderBy(F.size(F.split("path", "/")).desc())
            for row in folders.toLocalIterator():
                warnings += apply_metadata(f"{staging}/{row['path']}", row.asDict())
        os.replace(staging, folder)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return warnings


def apply_metadata(path: str, entry: dict) -> list[str]:
    """Mode and time of one entry; what the system refuses becomes a warning."""
    out = []
    try:
        if entry.get("mode") is not None and entry["kind"] != "symlink":
            if not container.valid_mode(entry["mode"]):
                raise ValueError(f"mode {entry['mode']!r}")
            os.chmod(path, entry["mode"])
        if entry.get("mtime_ns") is not None:
            os.utime(path, ns=(entry["mtime_ns"], entry["mtime_ns"]), follow_symlinks=False)
    except (OSError, OverflowError, TypeError, ValueError, NotImplementedError) as error:
        out.append(f"{entry['path']}: {error}")
    return out


def verify_restore(spark: SparkSession, archive: str, folder: str) -> DataFrame:
    """path, problem for every entry of the archive that the folder doesn't hold as it should."""
    roots = [os.path.join(folder, n) for n in sorted(os.listdir(folder))]
    register(spark)
    found = None
    for root in roots:
        rows, _ = walked(spark, root, allow_system=True)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return section(spark, archive, "entries").select("path", F.lit("missing").alias("problem"))
    restored = contents(found).withColumns({"size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})
    return manifest.restore_check(section(spark, archive, "entries"), restored)


def verify_three(spark: SparkSession, archive: str, original: str, restored: str) -> DataFrame:
    """path, problem: entries of the archive against the original tree and the restored one.

    The first problem counts, in this order: missing in a tree, kind, size, content, link target, mode, time.  A tree
    is named by the folder it stands for in the archive.
    """
    entries = section(spark, archive, "entries")
    sides = {}
    for name, root in (("original", original), ("restored", restored)):
        rows, _ = walked(spark, root, allow_system=True)
        full = contents(rows).select("path", "kind", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "target", "mode", "mtime_ns")
        sides[name] = full.select("path", F.struct(*full.columns[1:]).alias(name))
    out = entries.select("path", F.struct("kind", "size", "sha256", "target", "mode", "mtime_ns").alias("entry"))
    for name, side in sides.items():
        out = out.join(side, "path", "left")
    problem = F.lit(None).cast("string")
    for column, what in reversed((("kind", "kind"), ("size", "size"), ("sha256", "content"), ("target", "target"), ("mode", "mode"), ("mtime_ns", "time"))):
        for name in ("restored", "original"):
            differs = ~F.col("entry")[column].eqNullSafe(F.col(name)[column])
            if column in ("mode", "mtime_ns"):
                differs &= F.col("entry")[column].isNotNull() & (F.col("entry")["kind"] != "symlink")
            problem = F.when(differs, F.lit(f"{name}: {what}")).otherwise(problem)
    for name in ("restored", "original"):
        problem = F.when(F.col(name).isNull(), F.lit(f"{name}: missing")).otherwise(problem)
    return out.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def estimate(spark: SparkSession, root: str, allow_system: bool = False) -> DataFrame:
    """What each file would take by itself: path, codec, size, stored_size."""
    rows, _ = walked(spark, root, allow_system)
    full = contents(rows.where("kind = 'file'")).where("content IS NOT NULL")
    named = full.select("path", "content", "size", policy.requested_method(F.col("path")).alias("requested_method"), policy.default_codec(F.col("path")).alias("codec"))
    return codec.compress(named, keep_payload=False).select("path", "codec", "size", "stored_size")


def analyze(spark: SparkSession, root: str, allow_system: bool = False) -> DataFrame:
    """What packing would give by codec, without writing."""
    rows, _ = walked(spark, root, allow_system)
    full = contents(rows.where("kind = 'file'")).where("content IS NOT NULL")
    return codec.analyze(full.select("content", "size", policy.requested_method(F.col("path")).alias("requested_method"), policy.default_codec(F.col("path")).alias("codec")))
