"""Archives whose metadata never meet on the driver: bytes, checks and answers are those of the whole-document way."""

import json
import os
import random

import pytest

from cairnspark.operators import archive
from cairnspark.sources import bundle, container, remote, store


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("large")
    rng = random.Random(1)
    words = ["río", "Straße", " ", 'quo"te', "back\\slash", "of", "shore", "x" * 40, *(f"w{k}" for k in range(300))]
    for k in range(240):
        folder = root / f"tree/d{k % 7}/s{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        text = " ".join(rng.choice(words) for _ in range(k % 50)) if k % 9 else "the same shore"
        (folder / f"f{k:03d}{('.txt', '.md', '.bin')[k % 3]}").write_text(text)
    (root / "tree/link").symlink_to("d0")
    path = str(root / "out/a.cairn")
    os.makedirs(os.path.dirname(path))
    archive.pack_all(spark, [str(root / "tree")], path, created_at="now", archive_id="a")
    return path


def test_parts_give_the_bytes_of_the_whole(packed):
    header, manifest, index = container.read_archive(packed)
    data = open(packed, "rb").read()
    for part, value in (("manifest", manifest), ("index", index)):
        start = header[f"{part}_offset"]
        assert data[start : start + header[f"{part}_length"]] == container.canonical_json(value)
        assert open(f"{packed}.{part}.json", "rb").read() == container.pretty_json(value)
    assert len(index["lexical"]["postings"]) > 300
    assert sorted(os.listdir(os.path.dirname(packed))) == ["a.cairn", "a.cairn.index.json", "a.cairn.manifest.json"]


def test_partitions_hold_places_and_no_rows(packed):
    _, manifest, index = container.read_archive(packed)
    for section, rows in (("entries", len(manifest["entries"])), ("documents", len(index["lexical"]["documents"])), ("postings", sum(map(len, index["lexical"]["postings"].values())))):
        reader = bundle.BundleReader({"path": packed, "section": section, "rows_per_task": "50"})
        parts = reader.partitions()
        assert len(parts) > 1 and all(p.rows == [] for p in parts)
        assert sum(len([*reader.read(p)]) for p in parts) == rows


def test_a_scan_refuses_what_a_whole_check_refuses(packed):
    header, manifest, index = container.read_archive(packed)
    entries = manifest["entries"]
    first = next(iter(index["lexical"]["documents"]))
    docs, posts = index["lexical"]["documents"], index["lexical"]["postings"]
    term = next(t for t, ids in posts.items() if len(ids) > 1)
    bad = [
        (manifest | {"entries": [*entries[:-1], entries[0]]}, index),
        (manifest | {"entries": [*entries[:-1], entries[-1] | {"path": entries[0]["path"]}]}, index),
        (manifest | {"entries": [*entries[:-2], entries[-2] | {"path": "tree/link/evil"}, entries[-1]]}, index),
        (manifest | {"entries": [*entries[:-1], entries[-1] | {"path": "../x"}]}, index),
        (manifest | {"entries": entries[:-1]}, index),
        (manifest | {"archive_id": "b"}, index),
        (manifest, index | {"lexical": {"documents": docs | {first: docs[first] | {"path": "other"}}, "postings": posts}}),
        (manifest, index | {"lexical": {"documents": docs, "postings": posts | {term: posts[term][::-1]}}}),
        (manifest, index | {"lexical": {"documents": docs, "postings": posts | {"new": ["e99999999"]}}}),
        (manifest, index | {"lexical": {"documents": docs}}),
        (manifest, index | {"schema_version": 9}),
    ]
    for dump in (container.canonical_json, container.pretty_json):
        found = container.scan(dump(manifest), dump(index), header, rows=50)
        assert found.documents == len(docs) and sum(found.codecs.values()) == len(entries)
        for m, i in bad:
            with pytest.raises(container.FormatError):
                container.checked_pair(header, m, i)
            with pytest.raises(container.FormatError):
                container.scan(dump(m), dump(i), header, rows=50)
    old = {"schema": "cairn.index", "schema_version": 1, "postings": posts, "documents": docs, "archive_id": "a"}
    assert container.scan(container.canonical_json(manifest), json.dumps(old).encode(), header).documents == len(docs)


def test_text_is_taken_in_blocks(monkeypatch):
    monkeypatch.setattr(container, "BLOCK", 7)
    value = {"a": [1, 23456789012, "ü€😀" * 5, {"b": None}, []], "c": 1.5e10, "d": {}}
    source = container.Json(json.dumps(value, ensure_ascii=False).encode(), "x")
    cut = container.Cutter(2)
    got = {k: [*source.items(cut)] if k == "a" else source.value() for k in source.members()}
    assert got == value and source.peek() == ""
    assert [x for b in cut.blocks for x in container.block_of(source.data, b, "x")] == value["a"] and len(cut.blocks) == 3


def test_remote_answers_keep_few_rows(spark, packed, monkeypatch):
    s = store.LocalStore(os.path.dirname(packed))
    seen = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (seen.append(len(data)), make(self, data, *a, **k))[1])
    got = remote.execute(spark, s, remote.Request("search", "a.cairn", "shore of w1 w2", limit=3)).rows.collect()
    listed = remote.execute(spark, s, remote.Request("list", "a.cairn", limit=5)).rows.collect()
    assert max(seen) <= 3 * 4
    monkeypatch.undo()
    from cairnspark.operators import search

    assert got == search.search(archive.section(spark, packed, "documents"), "shore of w1 w2", 3).collect()
    assert [r["position"] for r in listed] == [0, 1, 2, 3, 4]
    info = remote.execute(spark, s, remote.Request("info", "a.cairn"))
    assert {r["codec"]: r["count"] for r in info.rows.collect()} == container.scan_archive(packed).codecs


def test_sidecar_entries_are_read_in_blocks(spark, packed):
    wanted = [(e["entry_id"], e["path"], e["size"], e.get("target")) for e in container.read_archive(packed)[1]["entries"]]
    got = bundle.sidecar(spark, packed, rows=50)
    assert got.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, got.select("entry_id", "path", "size", "target").collect())) == sorted(wanted)


def test_find_all_looks_at_every_item(spark, tmp_path):
    for k in range(2100):
        (tmp_path / f"t/a{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"t/a{k % 2}/doc-{k:05d}.md").touch()
    deep = tmp_path / "t" / "/".join("abcdefghijk")
    deep.mkdir(parents=True)
    (deep / "doc-1.md").touch()
    s = store.LocalStore(str(tmp_path))
    wanted = sorted(i.path for i in s.find("t", "doc-*1.md", None, None))
    assert len(wanted) == 211 and sorted(r["path"] for r in store.find_all(spark, s, "t", ["doc-*1.txt", "doc-*1.md"]).collect()) == wanted


def test_queries_of_trees_and_logs_pack_nothing(spark, monkeypatch):
    from cairnspark.plans import archives, catalog

    def never(*_, **__):
        raise AssertionError("packed")

    monkeypatch.setattr(archives, "PLACES", {})
    monkeypatch.setattr(archive, "pack_all", never)
    for name in ("log_appended_and_read", "tree_analyze", "store_find"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_sections_and_walks_need_no_planning_processes(spark, packed):
    archive.register(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    source = spark.read.format("bundle")
    for name in bundle.SCHEMAS:
        got = archive.section(spark, packed, name)
        there = source.option("section", name).load(packed)
        assert "BatchScan" not in plan(got) and got.schema == there.schema
        assert sorted(map(str, got.collect())) == sorted(map(str, there.collect()))
    root = os.path.join(os.path.dirname(os.path.dirname(packed)), "tree")
    rows = archive.walked(spark, root)[0]
    assert "BatchScan" not in plan(rows) and rows.count() == spark.read.format("filetree").load(root).count()


def test_named_terms_are_read_from_their_blocks(spark, packed):
    postings = archive.section(spark, packed, "postings")
    wanted = ["shore", "w7", "absent"]
    got = archive.section(spark, packed, "postings", wanted)
    assert sorted(got.collect()) == sorted(postings.where(postings.term.isin(wanted)).collect()) and got.count() > 1
    reader = bundle.BundleReader({"path": packed, "section": "postings", "rows_per_task": "10"})
    every = len(reader.partitions())
    reader.terms = {*wanted}
    assert len(reader.partitions()) <= 3 < every


def test_an_archive_that_changed_since_it_was_opened_is_refused(spark, packed, tmp_path):
    path = str(tmp_path / "b.cairn")
    with open(packed, "rb") as one, open(path, "wb") as two:
        two.write(one.read())
    rows = archive.section(spark, path, "entries")
    assert rows.count() > 240
    os.utime(path, ns=(1, 1))
    with pytest.raises(Exception, match="changed after it was opened"):
        rows.collect()
