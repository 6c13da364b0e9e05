import json
import os

import pytest

from cairnspark import cli
from cairnspark.operators import archive, rules
from cairnspark.sources import container, logs, remote, store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "sub/.git").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a.txt").write_text("Привет needle\n" * 50)
    (root / "sub/copy.md").write_text("Привет needle\n" * 50)
    (root / "sub/.git/config").write_text("secret")
    (root / "_hidden.bin").write_bytes(bytes(range(256)))
    (root / "zero.txt").write_text("")
    (root / "link").symlink_to("a.txt")
    (root / "dangling").symlink_to("nowhere")
    os.chmod(root / "a.txt", 0o640)
    os.utime(root / "empty", ns=(10**18, 10**18))
    return root


@pytest.fixture
def packed(spark, tree, tmp_path):
    path = str(tmp_path / "out.cairn")
    skipped = archive.pack(spark, str(tree), path, created_at="now")
    assert [tuple(r) for r in skipped.collect()] == [("tree/sub/.git", "protected")]
    return path


def test_round_trip(spark, tree, packed, tmp_path):
    header, manifest, index = container.read_archive(packed)
    assert header["format_version"] == 2
    kinds = {e["path"]: e["kind"] for e in manifest["entries"]}
    assert kinds == {"tree": "dir", "tree/_hidden.bin": "file", "tree/a.txt": "file", "tree/dangling": "symlink", "tree/empty": "dir", "tree/link": "symlink", "tree/sub": "dir", "tree/sub/copy.md": "file", "tree/zero.txt": "file"}
    copy = next(e for e in manifest["entries"] if e["path"] == "tree/sub/copy.md")
    assert copy["dedup_of"] == next(e for e in manifest["entries"] if e["path"] == "tree/a.txt")["entry_id"]
    target = str(tmp_path / "back")
    assert archive.restore(spark, packed, target) == [] and not os.path.exists(target)
    assert archive.restore(spark, packed, target, apply=True) == []
    assert (tmp_path / "back/tree/a.txt").read_text() == (tree / "a.txt").read_text()
    assert os.stat(tmp_path / "back/tree/a.txt").st_mode & 0o777 == 0o640
    assert os.readlink(tmp_path / "back/tree/dangling") == "nowhere"
    assert os.stat(tmp_path / "back/tree/empty").st_mtime_ns == 10**18
    assert archive.verify_restore(spark, packed, target).count() == 0
    (tmp_path / "back/tree/a.txt").write_text("other")
    assert [tuple(r) for r in archive.verify_restore(spark, packed, target).collect()] == [("tree/a.txt", "size")]
    with pytest.raises(archive.GuardError):
        archive.restore(spark, packed, target, apply=True)
    with pytest.raises(archive.GuardError):
        archive.pack(spark, str(tree), str(tree / "inside.cairn"))


def test_sections_and_pushdown(spark, packed):
    postings = archive.section(spark, packed, "postings").where("term = 'needle'")
    assert sorted(r["entry_id"] for r in postings.collect()) == sorted(r["entry_id"] for r in archive.section(spark, packed, "documents").where("array_contains(terms, 'needle')").collect())
    assert archive.section(spark, packed, "header").count() == 1
    assert rules.violations(archive.section(spark, packed, "header"), "archive_id", rules.header_rules()).count() == 0
    assert {r["path"] for r in archive.section(spark, packed, "payload").collect()} == {"tree/a.txt", "tree/sub/copy.md", "tree/_hidden.bin", "tree/zero.txt"}
    assert rules.manifest_violations(archive.section(spark, packed, "entries")).count() == 0


def damaged(path, at, tmp_path, name):
    data = bytearray(open(path, "rb").read())
    data[at] ^= 1
    out = tmp_path / name
    out.write_bytes(data)
    return str(out)


def test_damage_is_found(spark, packed, tmp_path):
    header, manifest, _ = container.read_archive(packed)
    for name, at in (("magic", 0), ("manifest", header["manifest_offset"]), ("index", header["index_offset"])):
        with pytest.raises(container.FormatError):
            container.read_archive(damaged(packed, at, tmp_path, name))
    entry = next(e for e in manifest["entries"] if e["path"] == "tree/a.txt")
    bad = damaged(packed, header["data_offset"] + entry["chunk_offset"] + 12, tmp_path, "data")
    container.read_archive(bad)  # metadata alone is fine
    with pytest.raises(Exception):  # noqa: B017  Spark wraps what the task raised
        archive.restore(spark, bad, str(tmp_path / "never"), apply=True)
    assert not os.path.exists(tmp_path / "never")
    with open(packed, "ab") as f:
        f.write(b"x")
    with pytest.raises(container.FormatError):
        container.read_archive(packed)


def entry(path, kind="file", **more):
    return {"entry_id": "e" + path, "path": path, "kind": kind, "size": 0, "sha256": "0" * 64, "codec": "store", "stored_size": 0, "chunk_id": "c", "chunk_offset": 0, "chunk_length": 0, "searchable": False} | more


def test_unsafe_manifests_are_refused(tmp_path):
    index = {"schema": "cairn.index", "schema_version": 2, "archive_id": "a", "lexical": {"documents": {}, "postings": {}}}
    for entries in ([entry("../x")], [entry("a"), entry("a")], [entry("l", "symlink", target="/etc"), entry("l/evil")], [entry("a", chunk_length=5, stored_size=5), entry("b", chunk_offset=-1, chunk_id="d")]):
        manifest = {"schema": "cairn.manifest", "schema_version": 2, "archive_id": "a", "entries": entries}
        with pytest.raises(container.FormatError):
            container.write_archive(str(tmp_path / "x"), manifest, index, [], "now")
    assert os.listdir(tmp_path) == []


class Recorder(store.LocalStore):
    def __init__(self, root):
        super().__init__(root)
        self.ranges = []

    def read_range(self, path, offset, length):
        self.ranges.append((path, offset, length))
        return super().read_range(path, offset, length)


class NoRanges(store.LocalStore):
    def read_range(self, path, offset, length):
        raise NotImplementedError


def test_remote_reads(spark, packed, tmp_path):
    local = Recorder(str(tmp_path / "cloud"))
    assert remote.push(local, packed, "w/a.cairn")["applied"] is False and local.get_meta("w/a.cairn") is None
    assert remote.push(local, packed, "w/a.cairn", apply=True)["applied"]
    local.ranges.clear()
    out = remote.execute(spark, local, remote.Request("search", "w/a.cairn", "needle"))
    header, _, _ = container.read_archive(packed)
    assert len(local.ranges) == 3 and all(offset + length <= header["data_offset"] for _, offset, length in local.ranges)
    t = out.telemetry.as_dict()
    assert (t["range_reads"], t["sidecar_reads"], t["data_section_read"]) == (3, 0, False)
    assert {r["path"] for r in out.rows.collect()} == {"tree/a.txt", "tree/sub/copy.md"}
    again = remote.execute(spark, NoRanges(str(tmp_path / "cloud")), remote.Request("search", "w/a.cairn", "needle", mode="semantic"))
    assert (again.telemetry.range_reads, again.telemetry.sidecar_reads, again.mode_used, again.fallback_reason) == (0, 2, "lexical", "backend-missing")
    assert sorted(again.rows.collect()) == sorted(out.rows.collect())
    assert remote.execute(spark, local, remote.Request("info", "w/a.cairn")).info["entry_count"] == 9
    assert remote.execute(spark, local, remote.Request("list", "w/a.cairn", limit=4)).rows.count() == 4
    got = str(tmp_path / "got.cairn")
    assert remote.pull(local, "w/a.cairn", got, apply=True)["applied"] and open(got, "rb").read() == open(packed, "rb").read()
    (tmp_path / "cloud/w/a.cairn.index.json").write_text("{}")
    with pytest.raises(container.FormatError):
        remote.pull(local, "w/a.cairn", got, apply=True)


def test_requests_are_checked_before_any_read(spark):
    class Untouchable(store.UnconfiguredStore):
        def _refuse(self, *_, **__):
            raise AssertionError

        get_meta = _refuse

    for bad in (remote.Request("erase", "a.cairn"), remote.Request("info", "../a.cairn"), remote.Request("info", "a.txt"), remote.Request("search", "a.cairn"), remote.Request("list", "a.cairn", limit=True), remote.Request("search", "a.cairn", "x", mode="odd"), remote.Request("info", "a.cairn", protocol_version="9")):
        with pytest.raises(remote.RequestError):
            remote.execute(spark, Untouchable(), bad)


def test_local_store(tmp_path):
    s = store.LocalStore(str(tmp_path / "s"))
    (tmp_path / "f").write_bytes(b"0123456789")
    s.upload(str(tmp_path / "f"), "d/one.txt")
    s.ensure_folder("d/sub")
    s.upload(str(tmp_path / "f"), "d/sub/two.md")
    assert [i.path for i in s.list_folder("d")] == ["d/one.txt", "d/sub"] and s.list_folder("none") == []
    assert [i.path for i in s.find("", "*.md")] == ["d/sub/two.md"]
    assert s.read_range("d/one.txt", 2, 3) == b"234"
    for bad in (lambda: s.read_range("d/one.txt", 8, 5), lambda: s.read_bytes("../f"), lambda: s.upload(str(tmp_path / "f"), "d/one.txt"), lambda: s.read_bytes("none"), lambda: store.UnconfiguredStore().get_meta("x")):
        with pytest.raises(store.StoreError):
            bad()
    s.delete("d")
    assert s.get_meta("d") is None


def test_rest_store(tmp_path):
    files = {"a/x.cairn": b"0123456789"}
    calls = []

    def http(method, url, headers, body):
        calls.append((method, url))
        assert headers["Authorization"] == "OAuth t"
        if url.startswith("http://blob/"):
            name = url.removeprefix("http://blob/")
            if method == "PUT":
                files[name] = body
                return store.Reply(201)
            span = headers.get("Range", "").removeprefix("bytes=").split("-")
            return store.Reply(206, files[name][int(span[0]) : int(span[1]) + 1]) if len(span) > 1 and name != "a/whole" else store.Reply(200, files[name])
        from urllib.parse import parse_qs, urlsplit

        path = parse_qs(urlsplit(url).query)["path"][0].removeprefix("disk:/")
        if "/download" in url or "/upload" in url:
            return store.Reply(200, json.dumps({"href": f"http://blob/{path}"}).encode())
        if path == "secret":
            return store.Reply(403)
        if path == "odd":
            return store.Reply(200, b"<html>")
        if path in files:
            return store.Reply(200, json.dumps({"path": f"disk:/{path}", "type": "file", "size": len(files[path])}).encode())
        if path in ("a", ""):
            items = [{"path": f"disk:/{n}", "type": "file", "size": len(d)} for n, d in files.items()] if path else [{"path": "disk:/a", "type": "dir"}]
            return store.Reply(200, json.dumps({"path": "disk:/a", "type": "dir", "_embedded": {"items": items}}).encode())
        return store.Reply(404)

    s = store.RestStore("http://api", http, "t")
    assert s.read_range("a/x.cairn", 2, 3) == b"234" and s.read_bytes("a/x.cairn") == b"0123456789"
    files["a/whole"] = b"abcdef"
    assert s.read_range("a/whole", 1, 2) == b"bc"
    assert [i.path for i in s.find("", "*.cairn")] == ["a/x.cairn"] and s.get_meta("gone") is None and s.list_folder("gone") == []
    (tmp_path / "f").write_bytes(b"new")
    assert s.upload(str(tmp_path / "f"), "a/n").size == 3
    for bad in (lambda: s.get_meta("secret"), lambda: s.get_meta("odd"), lambda: s.get_meta("../x"), lambda: store.RestStore("http://api", http)):
        with pytest.raises(store.StoreError) as e:
            bad()
        assert "OAuth" not in str(e.value)


def test_logs(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert logs.read(spark, folder).count() == 0
    for n in (1, 2):
        logs.append(spark.createDataFrame([(10 * n, 4, "hidden")], "raw_bytes long, packed_bytes long, password string"), folder)
    rows = logs.read(spark, folder).collect()
    assert sorted(r["raw_bytes"] for r in rows) == [10, 20] and all(r["timestamp"] and r["schema_version"] == 1 for r in rows)
    assert "hidden" not in "".join(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".json"))


def test_cli(spark, tree, tmp_path, capsys):
    path = str(tmp_path / "cli.cairn")

    def run(*arguments):
        code = cli.main(["--json", *arguments])
        return code, json.loads(capsys.readouterr().out.splitlines()[-1])

    assert run("version")[0] == 0 and run("runtime")[1]["zstd"] is True
    assert run("pack", str(tree), path)[1]["applied"] is False and not os.path.exists(path)
    assert run("pack", str(tree), path, "--apply")[1]["by_reason"] == [{"reason": "protected", "paths": 1}, {"reason": "total", "paths": 1}] or os.path.exists(path)
    assert run("search", path, "needle", "--limit", "1")[1]["results"][0]["path"] == "tree/a.txt"
    assert run("search", path, "needle", "--limit", "0")[0] == 2
    assert len(run("list", path)[1]) == 9 and run("info", path)[1]["header"]["entry_count"] == 9
    assert run("info", str(tmp_path / "none"))[0] == 2
    assert run("push", path, "p/x.cairn", "--store", str(tmp_path / "c"), "--apply")[1]["applied"]
    assert run("open", "p/x.cairn", "search", "--query", "needle", "--store", str(tmp_path / "c"))[1]["telemetry"]["range_reads"] == 3
    assert [i["path"] for i in run("ls-cloud", "", "--find", "*.cairn", "--store", str(tmp_path / "c"))[1]] == ["p/x.cairn"]
    assert run("unpack", path, str(tmp_path / "u"), "--apply")[1]["warnings"] == []
    assert run("stats", str(tmp_path / "nolog"))[1]["records"] == 0
