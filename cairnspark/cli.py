"""Commands: analyze, pack, unpack, info, list, search, push, pull, ls-cloud, open, fetch, stats, runtime, version,
bench, doctor, selfcheck, check-telemetry, badge and manual.

What changes anything is a preview unless ``--apply`` is given.  An expected error ends with status 2, as JSON where
``--json`` asks for it.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.errors import PySparkException

from . import config, session
from .operators import archive, benchmarks, codec, reports, search, semantic
from .sources import container, filetree, logs, remote, store

VERSION = "1.0.0"
ERRORS = (config.ConfigError, container.FormatError, archive.GuardError, search.SearchError, semantic.MismatchError, remote.RequestError, store.StoreError, codec.CodecError, filetree.TreeError, FileNotFoundError, PySparkException)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairnspark", description=__doc__)
    out.add_argument("--json", action="store_true")
    out.add_argument("--config", help="settings as JSON")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, apply: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if apply:
            c.add_argument("--apply", "--yes", action="store_true")
        return c

    command("analyze", "root").add_argument("--allow-system", action="store_true")
    c = command("pack", apply=True)
    c.add_argument("roots", nargs="+", help="inputs, then the archive")
    for flag in ("--allow-system", "--no-index", "--no-dedup", "--accept-changing", "--force"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--most-bytes", type=int)
    c.add_argument("--log", help="folder of the savings log")
    c.add_argument("--project")
    c = command("unpack", "archive", "folder", apply=True)
    for flag in ("--no-metadata", "--allow-system"):
        c.add_argument(flag, action="store_true")
    command("info", "archive")
    command("list", "archive")
    c = command("search", "archive", "query")
    c.add_argument("--limit", type=int, default=search.DEFAULT_LIMIT)
    c.add_argument("--mode", default="lexical")
    for name in ("push", "pull"):
        c = command(name, "archive", "path", apply=True)
        c.add_argument("--store")
        c.add_argument("--log", help="folder of the action log")
        if name == "pull":
            c.add_argument("--unpack", metavar="FOLDER")
        else:
            c.add_argument("--pack", nargs="*", metavar="INPUT")
    c = command("ls-cloud", "path")
    c.add_argument("--store")
    c.add_argument("--find")
    for name in ("open", "fetch"):
        c = command(name, "path", "operation")
        c.add_argument("--store")
        c.add_argument("--query")
        c.add_argument("--limit", type=int, default=search.DEFAULT_LIMIT)
        c.add_argument("--mode", default="lexical")
    command("stats", "folder")
    command("runtime").add_argument("--backend", help="module of a semantic backend")
    c = command("bench", "bytes")
    c.add_argument("--files", type=int, default=1)
    c.add_argument("--no-index", action="store_true")
    command("doctor").add_argument("--backend")
    command("selfcheck")
    command("check-telemetry", "file")
    command("badge", "file")
    command("manual")
    command("version")
    return out


def rows(df) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


#: What the telemetry of an answer holds.
TELEMETRY = ("range_reads", "range_bytes", "sidecar_reads", "sidecar_bytes", "bytes_read", "data_section_read", "mode_used")


def runtime(backend: str | None) -> dict:
    found, problems = semantic.probe(backend) if backend else (None, [])
    return {"zstd": codec.zstd_available(), "semantic_backend": None if found is None or problems else found.descriptor, "problems": problems, "modes": list(semantic.MODES)}


def check_telemetry(path: str) -> dict:
    """Whether an answer's telemetry, as JSON, has all fields and says that only metadata was read."""
    with open(path, encoding="utf-8") as f:
        found = container.parse_json(f.read().encode(), path)
    found = found.get("telemetry", found)
    missing = [n for n in TELEMETRY if n not in found]
    wrong = [] if missing else [w for w, bad in (("range_reads", found["range_reads"] not in (0, 3)), ("data_section_read", found["data_section_read"] is not False), ("bytes_read", found["bytes_read"] != found["range_bytes"] + found["sidecar_bytes"])) if bad]
    return {"ok": not missing and not wrong, "missing": missing, "wrong": wrong}


def selfcheck(spark) -> dict:
    """Packs, reads, searches, restores and verifies a small tree of its own."""
    with tempfile.TemporaryDirectory() as work:
        os.makedirs(f"{work}/tree/notes")
        for name, text in (("a.txt", "a small river"), ("notes/b.md", "the river again")):
            with open(f"{work}/tree/{name}", "w", encoding="utf-8") as f:
                f.write(text)
        archive.pack(spark, f"{work}/tree", f"{work}/t.cairn")
        out = remote.execute(spark, store.LocalStore(work), remote.Request("search", "t.cairn", "river"))
        archive.restore(spark, f"{work}/t.cairn", f"{work}/out", apply=True)
        steps = {"search": out.rows.count() == 2, "ranges": out.telemetry.range_reads == 3, "restore": archive.verify_three(spark, f"{work}/t.cairn", f"{work}/tree", f"{work}/out/tree").isEmpty()}
    return {"ok": all(steps.values()), "steps": steps}


def run(a: argparse.Namespace) -> dict | list:
    settings = config.load(a.config)
    given = lambda name, path: config.setting(settings, path, getattr(a, name, None))
    folder = store.LocalStore(given("store", "store.root"))
    if a.command == "version":
        return {"version": VERSION, "format_versions": list(container.OWN.versions)}
    if a.command == "manual":
        return {"manual": __doc__ + parser().format_help()}
    if a.command == "runtime":
        return runtime(a.backend)
    if a.command == "doctor":
        return runtime(a.backend) | {"python": sys.version.split()[0], "settings": settings, "memory": benchmarks.process_memory()}
    if a.command == "check-telemetry":
        return check_telemetry(a.file)
    if a.command == "badge":
        with open(a.file, encoding="utf-8") as f:
            passed = container.parse_json(f.read().encode(), a.file).get("passed") is True
        return {"schemaVersion": 1, "label": "limits", "message": "kept" if passed else "broken", "color": "green" if passed else "red"}
    if a.command == "ls-cloud":
        return [vars(i) for i in (folder.find(a.path, a.find) if a.find else folder.list_folder(a.path))]
    if a.command == "info":
        header, manifest, _ = container.read_archive(a.archive)
        return {"header": header, "search": manifest.get("search"), "methods": manifest.get("methods"), "dedup": manifest.get("dedup")}
    if a.command in ("open", "fetch"):
        request = remote.Request(a.operation, a.path, a.query, a.limit, a.mode).checked()
    if a.command == "push" and not a.apply:
        return remote.push(folder, a.archive, a.path)
    if a.command == "pull" and not a.apply:
        return remote.pull(folder, a.path, a.archive)
    spark = session.session()
    archive.register(spark)
    if a.command == "push":
        return remote.push(folder, a.archive, a.path, True, spark, given("log", "logs.actions"), a.pack)
    if a.command == "pull":
        return remote.pull(folder, a.path, a.archive, True, spark, given("log", "logs.actions"), a.unpack)
    if a.command in ("open", "fetch"):
        out = remote.execute(spark, folder, request)
        return {"results": rows(out.rows), "info": out.info, "mode_used": out.mode_used, "fallback_reason": out.fallback_reason, "telemetry": out.telemetry.as_dict()}
    if a.command == "selfcheck":
        return selfcheck(spark)
    if a.command == "bench":
        with tempfile.TemporaryDirectory() as work:
            root = benchmarks.tree_of(spark, f"{work}/tree", int(a.bytes), a.files)
            runs = spark.createDataFrame(benchmarks.measured(spark, root, work, not a.no_index), "operation string, size_bytes long, seconds double, peak_rss_bytes long, temp_bytes long")
            kept = reports.slo(reports.throughput(runs), 256 * reports.MIB, 2.1, 1.1, 64 * reports.MIB)
            return {"runs": rows(kept), **rows(reports.passed(kept))[0]}
    if a.command == "analyze":
        return {"applied": False, "codecs": rows(archive.analyze(spark, a.root, a.allow_system))}
    if a.command == "pack":
        if len(a.roots) < 2:
            raise archive.GuardError("name the inputs and the archive")
        *roots, target = a.roots
        if not a.apply:
            return {"applied": False, "codecs": [row | {"input": r} for r in roots for row in rows(archive.analyze(spark, r, a.allow_system))]}
        done = archive.pack_all(
            spark, roots, target, dedup=not a.no_dedup and settings["pack"]["dedup"], indexed=not a.no_index and settings["pack"]["index"], allow_system=a.allow_system, overwrite=True,
            accept_changing=a.accept_changing, most_bytes=given("most_bytes", "pack.most_bytes"), force=a.force, log=given("log", "logs.savings"), project=given("project", "project"),
        )
        return {"applied": True, "skipped": rows(done.skipped), "by_reason": rows(reports.skip_summary(done.skipped)), "record": done.record, "warnings": done.warnings, "changing": done.changing, "backup": done.backup}
    if a.command == "unpack":
        if not a.apply:
            return {"applied": False, "plan": rows(archive.restore_plan(spark, a.archive))}
        return {"applied": True, "warnings": archive.restore(spark, a.archive, a.folder, True, not a.no_metadata, a.allow_system)}
    if a.command == "list":
        return rows(archive.section(spark, a.archive, "entries").orderBy("position"))
    if a.command == "search":
        out = semantic.answer(archive.section(spark, a.archive, "documents"), a.query, a.limit, a.mode)
        return {"results": rows(out.results), "mode_used": out.mode_used, "fallback_reason": out.fallback_reason}
    return rows(reports.savings_summary(logs.read(spark, a.folder)))[0]


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        print(json.dumps(run(a), ensure_ascii=False, indent=None if a.json else 2))
    except ERRORS as error:
        print(json.dumps({"error": str(error)[:500], "type": type(error).__name__}) if a.json else f"error: {error}", file=sys.stdout if a.json else sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
