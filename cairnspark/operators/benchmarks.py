"""Runs of benchmarks: artifacts that must add up, resuming, folder sizes and process memory."""

from __future__ import annotations

import json
import os
import re
import shutil
import threading
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import synthetic
from ..sources.container import pretty_json, publish
from .reports import missing
from .rules import Rule

RUN = "size_bytes long, profile string, status string, seconds double, peak_rss_bytes long"


def artifact_rules() -> list[Rule]:
    """Counts of an artifact(files, dirs, links, entries, index_documents, dedup_entries, unique_entries, dedup_ratio)."""
    return [
        ("entries", F.col("entries") != F.col("files") + F.col("dirs") + F.col("links")),
        ("documents", F.col("index_documents") > F.col("files")),
        ("dedup", F.col("dedup_entries") + F.col("unique_entries") != F.col("entries")),
        ("ratio", F.col("dedup_ratio") != T.share(F.col("dedup_entries"), F.col("entries"), 6)),
        ("negative", F.least("files", "dirs", "links", "entries", "index_documents", "dedup_entries", "unique_entries") < 0),
    ]


def save(path: str, settings: dict, runs: list[dict]) -> None:
    """Write what is done so far; the file is whole or as before."""
    publish({path: lambda out: out.write(pretty_json({"settings": settings, "runs": runs}))})


def resume(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """Completed runs of a saved file with exactly these settings; none where it is missing, damaged or of others."""
    try:
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
    except (FileNotFoundError, ValueError):
        saved = {}
    rows = saved.get("runs", []) if isinstance(saved, dict) and saved.get("settings") == settings else []
    names = [c.split()[0] for c in RUN.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows if r.get("status") == "passed"], RUN)


def left_to_do(spark: SparkSession, sizes: list[int], done: DataFrame) -> DataFrame:
    return missing(spark.createDataFrame([(s,) for s in sizes], "size_bytes long"), done, "size_bytes")


def tree_size(tree: DataFrame, pattern: str | None = None) -> DataFrame:
    """files and bytes of a walked tree, of the paths whose base name fits a shell pattern where one is given."""
    rows = tree.where((F.col("kind") == "file") & F.col("reason").isNull())
    if pattern is not None:
        rows = rows.where(T.base_name(F.col("path")).rlike(T.glob_regex(pattern)))
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def peak(columns: list[str]) -> Column:
    """The greatest of samples, baseline and high-water mark; missing ones don't count."""
    return reduce(lambda a, b: F.greatest(a, b), [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def process_memory(pid: int | str = "self") -> dict[str, int | str | None]:
    """Current and peak resident bytes of a process of this machine, and where they come from."""
    try:
        with open(f"/proc/{pid}/status", encoding="ascii", errors="replace") as f:
            found = dict(re.findall(r"(VmRSS|VmHWM):\s+(\d+) kB", f.read()))
        return {"rss": int(found["VmRSS"]) * 1024, "peak": int(found["VmHWM"]) * 1024, "source": "procfs"}
    except (OSError, KeyError):
        if pid != "self" and int(pid) != os.getpid():
            return {"rss": None, "peak": None, "source": "unavailable"}
        import resource

        most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if os.uname().sysname == "Darwin" else 1024)
        return {"rss": None, "peak": most, "source": "getrusage"}


class PeakMonitor:
    """The greatest resident size of processes while a block runs, sampled in a thread."""

    def __init__(self, pids: tuple[int | str, ...] = ("self",), every: float = 0.05):
        self.pids, self.every, self.samples, self.peak = pids, every, 0, 0

    def sample(self) -> None:
        now = sum(process_memory(p)["rss"] or 0 for p in self.pids)
        self.peak, self.samples = max(self.peak, now), self.samples + 1

    def __enter__(self) -> PeakMonitor:
        self.ended = threading.Event()
        self.sample()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            self.sample()

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()
        self.sample()


def missing_fields(present: Column, required: tuple[str, ...]) -> Column:
    """Names that a record should have and hasn't, in order."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def tree_of(spark: SparkSession, folder: str, size: int, count: int = 1, groups: int = 32) -> str:
    """A generated tree: one compressible file of ``size`` bytes, or ``count`` of that size in groups."""
    if count == 1:
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/large.txt", "wb") as f:
            for row in synthetic.blocks(spark, size).orderBy("position").toLocalIterator(prefetchPartitions=True):
                f.write(row["content"])
        return folder
    for row in synthetic.files(spark, count, size, groups).toLocalIterator():
        os.makedirs(os.path.dirname(f"{folder}/{row['path']}"), exist_ok=True)
        with open(f"{folder}/{row['path']}", "w", encoding="utf-8") as f:
            f.write(row["content"])
    return folder


def measured(spark: SparkSession, root: str, work: str, indexed: bool = True) -> list[dict]:
    """Packing and unpacking a tree end to end: a run for each, with seconds, peak and staging."""
    from . import archive

    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)
    target, out = f"{work}/measured-{uuid.uuid4().hex}.cairn", []
    jobs = {"pack": lambda: archive.pack_all(spark, [root], target, indexed=indexed), "unpack": lambda: archive.restore(spark, target, f"{target}.tree", apply=True)}
    for name, job in jobs.items():
        with PeakMonitor() as monitor:
            began = time.perf_counter()
            job()
            took = time.perf_counter() - began
        staged = os.path.getsize(target) if name == "pack" else size
        out.append({"operation": name, "size_bytes": size, "seconds": took, "peak_rss_bytes": monitor.peak, "temp_bytes": staged})
    shutil.rmtree(f"{target}.tree", ignore_errors=True)
    for end in ("", ".manifest.json", ".index.json"):
        os.unlink(target + end)
    return out
