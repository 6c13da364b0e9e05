"""Jobs as a user runs them: several inputs, guards, backups, logs, settings, probes and the commands around them."""

import json
import os
import sys
import types

import pytest
from pyspark.sql import functions as F

from cairnspark import cli, config
from cairnspark.operators import archive, benchmarks, semantic
from cairnspark.sources import container, filetree, logs, remote, store


@pytest.fixture
def trees(tmp_path):
    for name, text in (("one/a.txt", "the river"), ("one/b/c.md", "a shore"), ("two/a.txt", "the river"), ("two/z.bin", "x" * 100)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_several_inputs_in_one_archive(spark, trees):
    target = f"{trees}/all.cairn"
    done = archive.pack_all(spark, [f"{trees}/one", f"{trees}/two"], target)
    got = [(r["path"], r["dedup_of"] is not None) for r in archive.section(spark, target, "entries").orderBy("entry_id").collect()]
    assert got == [("one", False), ("one/a.txt", False), ("one/b", True), ("one/b/c.md", False), ("two", True), ("two/a.txt", True), ("two/z.bin", False)]
    assert done.record["raw_bytes"] == 9 + 7 + 9 + 100 and done.changing == 0
    with pytest.raises(archive.GuardError, match="two inputs are named"):
        archive.pack_all(spark, [f"{trees}/one", f"{trees}/two/../one"], f"{trees}/again.cairn")


def test_walk_order_over_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filetree.TreeReader, "FILES", 2)
    names = ["a", "a-b", "a.b", "b", "c.txt", "d", "d.x", "e", "f"]
    for n in names:
        (tmp_path / "r" / n).mkdir(parents=True) if n in ("a", "d") else (tmp_path / "r").mkdir(exist_ok=True) or (tmp_path / "r" / n).write_text(n)
    for n in ("a/x", "a/y", "d/z"):
        (tmp_path / "r" / n).write_text(n)
    rows, _ = archive.walked(spark, str(tmp_path / "r"))
    got = [(r["path"], r["position"]) for r in rows.orderBy("position").collect()]
    paths = sorted(["r", *(f"r/{n}" for n in [*names, "a/x", "a/y", "d/z"])], key=lambda p: p.split("/"))
    assert got == [(p, k) for k, p in enumerate(paths)]


def test_guards_backups_and_warnings(spark, trees):
    target = f"{trees}/t.cairn"
    with pytest.raises(archive.GuardError, match="over the limit"):
        archive.pack_all(spark, [f"{trees}/two"], target, most_bytes=50)
    done = archive.pack_all(spark, [f"{trees}/two"], target, most_bytes=50, force=True)
    assert any("over the limit" in w for w in done.warnings) and any("larger than its input" in w for w in done.warnings)
    with pytest.raises(archive.GuardError, match="exists"):
        archive.pack_all(spark, [f"{trees}/two"], target)
    before = open(target, "rb").read()
    again = archive.pack_all(spark, [f"{trees}/one"], target, overwrite=True)
    assert open(again.backup, "rb").read() == before != open(target, "rb").read()
    os.symlink(f"{trees}/one", f"{trees}/way")
    with pytest.raises(archive.GuardError, match="inside its own input"):
        archive.pack_all(spark, [f"{trees}/one"], f"{trees}/way/in.cairn")
    os.symlink(target, f"{trees}/link.cairn")
    with pytest.raises(archive.GuardError, match="is a link"):
        archive.restore(spark, f"{trees}/link.cairn", f"{trees}/out", apply=True)
    assert store.free_backup(target, "20260101T000000Z") == f"{target}.backup-20260101T000000Z"
    open(f"{target}.backup-20260101T000000Z", "w").close()
    assert store.free_backup(target, "20260101T000000Z").endswith("Z-1")


@pytest.mark.parametrize("field, value", [("mode", "644"), ("mode", True), ("mode", 0o10000), ("mode", -1), ("kind", "hardlink"), ("size", -5), ("sha256", "nope"), ("codec", "rar"), ("entry_id", None), ("target", "x"), ("searchable", 1), ("chunk_offset", 1.5), ("stored_size", 1)])
def test_entries_are_checked_on_every_open(field, value):
    entry = {"entry_id": "e0", "path": "a", "kind": "file", "size": 3, "sha256": "0" * 64, "codec": "store", "chunk_offset": 0, "chunk_length": 3, "stored_size": 3, "mode": 0o644, "searchable": True}
    assert container.entry_problem(entry) is None
    assert container.entry_problem(entry | {field: value}) == field
    if value is None:
        assert container.entry_problem({k: v for k, v in entry.items() if k != field}) == field


@pytest.mark.parametrize("block, problem", [(None, None), ({"status": "unavailable"}, None), ({"status": "ready", "model_id": "m", "dimensions": 3, "metric": "dot"}, None), ({"status": "maybe"}, "status"), ({"status": "ready", "model_id": " ", "dimensions": 3}, "model_id"), ({"status": "ready", "model_id": "m", "dimensions": True}, "dimensions"), ({"status": "unavailable", "metric": "angle"}, "metric")])
def test_semantic_blocks_are_checked(block, problem):
    assert container.semantic_problem(block) == problem


def test_unsorted_postings_are_refused():
    index = {"schema": "cairn.index", "schema_version": 2, "lexical": {"documents": {"a": {"path": "x"}, "b": {"path": "y"}}, "postings": {"t": ["b", "a"]}}}
    with pytest.raises(container.FormatError, match="sorted"):
        container.index_parts(index)


def test_three_way_check(spark, trees):
    target, out = f"{trees}/t.cairn", f"{trees}/out"
    archive.pack_all(spark, [f"{trees}/one"], target)
    archive.restore(spark, target, out, apply=True)
    check = lambda: sorted(tuple(r) for r in archive.verify_three(spark, target, f"{trees}/one", f"{out}/one").collect())
    assert check() == []
    os.chmod(f"{out}/one/a.txt", 0o600)
    os.unlink(f"{trees}/one/b/c.md")
    assert [p for p in check() if p[0] != "one/b"] == [("one/a.txt", "restored: mode"), ("one/b/c.md", "original: missing")]


def test_push_and_pull_log_what_they_do(spark, trees):
    cloud, log = store.LocalStore(f"{trees}/cloud"), f"{trees}/log"
    os.makedirs(cloud.root)
    done = remote.push(cloud, f"{trees}/t.cairn", "p/t.cairn", True, spark, log, roots=[f"{trees}/one"])
    assert done["record"]["operation"] == "pack"
    got = remote.pull(cloud, "p/t.cairn", f"{trees}/back.cairn", True, spark, log, folder=f"{trees}/out")
    assert got["applied"] and (trees / "out/one/a.txt").read_text() == "the river"
    (trees / "cloud/p/t.cairn.index.json").write_text("{}")
    with pytest.raises(container.FormatError):
        remote.pull(cloud, "p/t.cairn", f"{trees}/bad.cairn", True, spark, log)
    assert not [n for n in os.listdir(trees) if n.startswith("bad")]
    rows = sorted((r["operation"], r["status"]) for r in logs.read(spark, log, logs.ACTIONS).collect())
    assert rows == [("pull", "done"), ("pull", "failed"), ("push", "done")]


def test_pages_and_limits_of_stores(tmp_path):
    calls = []

    def http(method, url, headers, body):
        calls.append(url)
        at = int(url.split("offset=")[1]) if "offset=" in url else 0
        items = [{"path": f"disk:/f/{k:05d}", "type": "file", "size": 1} for k in range(at, min(at + 1000, 2500))]
        return store.Reply(200, json.dumps({"_embedded": {"items": items, "total": 2500}}).encode())

    rest = store.RestStore("https://example.invalid", http, "token")
    assert len(rest.list_folder("f")) == 2500 and len(calls) == 3
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text("")
    local = store.LocalStore(str(tmp_path))
    with pytest.warns(UserWarning, match="only 3 items"):
        assert len(local.find("", "*.txt", most=3)) == 3
    assert len(local.find("", "*.txt", most=None, depth=None)) == 5


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"pack": {"dedup": false}, "logs": "none"}')
    got = config.load(str(tmp_path / "c.json"))
    assert got["pack"] == {"index": True, "dedup": False, "most_bytes": None} and got["logs"] == "none"
    assert config.setting(got, "pack.dedup") is False and config.setting(got, "pack.x") is None and config.setting(got, "logs.x", 5) == 5
    assert config.load(str(tmp_path / "none.json")) == config.DEFAULTS
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.json"))


def test_probe_of_backends(monkeypatch):
    good = types.ModuleType("good_backend")
    good.find = lambda query, archive, limit: []
    good.SEARCH_CAPABILITIES = lambda: {"supported": True, "api_version": semantic.API_VERSION, "index_version": semantic.INDEX_VERSION, "function": "find", "descriptor": {"model_id": "m"}}
    old = types.ModuleType("old_backend")
    old.SEARCH_CAPABILITIES = {"supported": True, "api_version": "0", "function": print}
    for m in (good, old):
        monkeypatch.setitem(sys.modules, m.__name__, m)
    assert semantic.probe("good_backend")[1] == [] and callable(semantic.required("good_backend").function)
    assert "api-version" in semantic.probe("old_backend")[1][0] and "can't be imported" in semantic.probe("no_such_backend")[1][0]
    with pytest.raises(semantic.MismatchError):
        semantic.required("old_backend")


def test_monitor_and_missing_fields(spark):
    with benchmarks.PeakMonitor(every=0.01) as monitor:
        held = bytearray(30_000_000)
    assert monitor.peak > 30_000_000 and monitor.samples >= 2 and held is not None
    df = spark.createDataFrame([(["a", "c"],)], "have array<string>")
    assert df.select(benchmarks.missing_fields(F.col("have"), ("a", "b", "c", "d"))).first()[0] == ["b", "d"]


def test_commands(spark, trees, monkeypatch, capsys):
    monkeypatch.setattr(cli.session, "session", lambda: spark)
    call = lambda *a: (cli.main(["--json", *a]), json.loads(capsys.readouterr().out))
    assert call("selfcheck") == (0, {"ok": True, "steps": {"search": True, "ranges": True, "restore": True}})
    code, out = call("pack", f"{trees}/one", f"{trees}/two", f"{trees}/t.cairn", "--apply", "--log", f"{trees}/log")
    assert code == 0 and out["record"]["raw_bytes"] == 125 and call("stats", f"{trees}/log")[1]["records"] == 1
    assert call("pack", f"{trees}/one")[0] == 2
    code, out = call("bench", "20000", "--files", "3")
    assert code == 0 and [r["operation"] for r in out["runs"]] == ["pack", "unpack"]
    code, out = call("open", "t.cairn", "search", "--store", str(trees), "--query", "river")
    (trees / "answer.json").write_text(json.dumps(out))
    assert call("check-telemetry", f"{trees}/answer.json")[1]["ok"]
    (trees / "answer.json").write_text('{"telemetry": {"range_reads": 3}}')
    assert "bytes_read" in call("check-telemetry", f"{trees}/answer.json")[1]["missing"]
    (trees / "result.json").write_text('{"passed": true}')
    assert call("badge", f"{trees}/result.json")[1]["message"] == "kept" and "bench" in call("manual")[1]["manual"]
    assert call("doctor")[1]["memory"]["rss"] and call("runtime", "--backend", "no_such_backend")[1]["problems"]
