"""Inventory, archives, WebAssembly, feeds."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from palisade.operators import wasm
from palisade.sources import archives, feeds
from palisade.sources import files as inventory


def test_tree_to_files(spark, tmp_path):
    for name, data in {
        "src/a.py": b"x\xff\n", "node_modules/b.js": b"b", "lib/c.so": b"c", "d.bin.txt": b"d", ".bashrc": b"e", ".github/workflows/ci.yml": b"on: x", "pkg/__init__.py": b"", "big.txt": b"f" * 3_000_000,
    }.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "repo" / "src" / "a.py", tmp_path / "repo" / "link.py")
    files = inventory.prepare_files(inventory.read_tree(spark, str(tmp_path / "repo"), "r"))
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"src/a.py", "d.bin.txt", ".bashrc", ".github/workflows/ci.yml", "pkg/__init__.py", "big.txt"}
    assert got["src/a.py"].content == "x\ufffd\n" and got["src/a.py"].is_text and got["src/a.py"].is_script
    assert got[".bashrc"].declared_ext == "" and got[".bashrc"].detected_mime == "application/octet-stream"
    assert len(got["big.txt"].content) == 3_000_000 and got["big.txt"].sha256
    capped = inventory.prepare_files(inventory.read_tree(spark, str(tmp_path / "repo"), "r", max_size_mb=2.0), max_size_mb=2.0)
    assert {r.path for r in capped.where("content is null").collect()} == {"big.txt"}
    assert [(r.path, r.stage) for r in inventory.unreadable(capped).collect()] == [("big.txt", "read")]
    far = inventory.prepare_files(inventory.read_tree(spark, f"file://{tmp_path}/repo", "r"))
    assert {r.path: r.sha256 for r in far.collect()} == {k: r.sha256 for k, r in got.items()}
    remote = inventory.prepare_files(inventory.read_remote_tree(spark, f"file://{tmp_path}/repo", "r"))
    assert {r.path for r in remote.collect()} >= {"src/a.py", "d.bin.txt", "big.txt"}
    many = inventory.read_tree(spark, str(tmp_path), None).collect()
    assert {r.repo_id for r in many} == {"repo"} and "src/a.py" in {r.path for r in many}
    single = inventory.read_file(spark, str(tmp_path / "repo" / "src" / "a.py"), "r").first()
    assert (single.path, single.size) == ("a.py", 3)


def test_one_file_by_ranges(spark, tmp_path):
    """Ranges joined in order are the file, whatever its size and name; no range is larger than asked for."""
    for name, size in (("a b%41.bin", 10_007), ("even.bin", 4_096), ("empty.bin", 0), ("one.bin", 1)):
        body = bytes(i * 7 % 251 for i in range(size))
        (tmp_path / name).write_bytes(body)
        rows = inventory.read_ranges(spark, str(tmp_path / name), "r", 1024).orderBy("at").collect()
        assert b"".join(r.raw for r in rows) == body and [r.start for r in rows] == [1024 * i for i in range(-(-size // 1024))]
        assert all(len(r.raw) <= 1024 and (r.repo_id, r.size) == ("r", size) for r in rows)


def test_sniffed_text(spark):
    rows = [("r", "a.json", 2, bytearray(b"{}")), ("r", "b.rs", 9, bytearray(b"#!/bin/sh")), ("r", "c.rs", 2, bytearray(b"\x00\x01"))]
    df = spark.createDataFrame(rows, "repo_id string, path string, size long, raw binary")
    assert {r.path: r.is_text for r in inventory.with_flags(df).collect()} == {"a.json": False, "b.rs": False, "c.rs": False}
    assert {r.path: r.is_text for r in inventory.with_flags(df, "sniff").collect()} == {"a.json": True, "b.rs": True, "c.rs": False}


def test_decoding_equals_python(spark):
    import random

    rng = random.Random(11)
    raws = [bytes(rng.choice([65, 200, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 255]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = [("r", str(i), len(b), bytearray(b)) for i, b in enumerate(raws)]
    got = inventory.with_content(spark.createDataFrame(rows, "repo_id string, path string, size long, raw binary")).collect()
    for r in got:
        assert r.content == raws[int(r.path)].decode("utf-8", "replace")


def _zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return buffer.getvalue()


def _tar(members, mode="w:gz"):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return buffer.getvalue()


def test_archives(spark):
    inner = _zip([("n/x.txt", b"1"), ("dist/y.js", b"2"), ("z.zip", b"3")])
    rows = {
        "a.zip": _zip([("ok.txt", b"a"), ("../up.txt", b"b"), ("/abs.txt", b"c"), ("c:d.txt", b"d"), ("node_modules/m.js", b"e"), ("in.zip", inner), ("fake.gz", b"no"), ("dir/", b"")]),
        "b.tar.gz": _tar([("t.txt", b"t"), ("deep/in.tar", _tar([("q.txt", b"q")], "w"))]),
        "c.tgz": _tar([("u.txt", b"u")]),
        "d.tar": _tar([("v.txt", b"v")], "w"),
        "e.zip": _zip([("w.txt", b"w" * 500)])[:200],
        "f.zip": os.urandom(300),
        "g.rar": b"Rar!",
        "h.txt": _zip([("x.txt", b"x")]),
        "big.zip": _zip([("big.txt", b"0" * (11 * 1024 * 1024)), ("small.txt", b"s")]),
    }
    df = spark.createDataFrame([("r", k, bytearray(v)) for k, v in rows.items()], "repo_id string, path string, raw binary")
    got = {(r.archive, r.path): bytes(r.raw) for r in archives.expand_archives(df, archives.BOMB_LIMITS).collect()}
    assert got == {
        ("a.zip", "ok.txt"): b"a", ("a.zip", "in/n/x.txt"): b"1", ("b.tar.gz", "t.txt"): b"t", ("b.tar.gz", "in/q.txt"): b"q",
        ("c.tgz", "u.txt"): b"u", ("d.tar", "v.txt"): b"v", ("big.zip", "small.txt"): b"s",
    }


def test_archive_member_limit(spark):
    data = _zip([(f"f{i}.txt", b"") for i in range(archives.ARCHIVE_MAX_MEMBERS + 5)])
    df = spark.createDataFrame([("r", "many.zip", bytearray(data))], "repo_id string, path string, raw binary")
    assert archives.expand_archives(df).count() == archives.ARCHIVE_MAX_MEMBERS + 5
    assert archives.expand_archives(df, archives.BOMB_LIMITS).count() == archives.ARCHIVE_MAX_MEMBERS
    assert [r.reason for r in archives.archive_errors(df, archives.BOMB_LIMITS).collect()] == ["many.zip: more than 10000 members"]


def test_archive_null_bytes_and_nested_bomb(spark):
    inner = _zip([(f"n{i}.txt", b"0" * 1000) for i in range(50)])
    data = _zip([("a.txt", b"a"), ("in.zip", inner), ("z.txt", b"z")])
    df = spark.createDataFrame([("r", "none.zip", None), ("r", "nested.zip", bytearray(data)), ("r", "bad.zip", bytearray(b"PK nonsense"))], "repo_id string, path string, raw binary")
    assert archives.expand_archives(df).count() == 52
    few = archives.ArchiveLimits(members=10)
    assert archives.expand_archives(df, few).count() == 10
    small = archives.ArchiveLimits(total_bytes=len(inner) + 5000)
    assert archives.expand_archives(df, small).count() == 5
    reasons = {r.path: r.reason for r in archives.archive_errors(df, few).collect()}
    assert reasons == {"none.zip": "none.zip: the bytes are missing", "nested.zip": "nested.zip: more than 10 members", "bad.zip": "bad.zip: damaged: BadZipFile"}


def _leb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _module(imports, count=None):
    """Imports of every kind in turn: function, table, memory, global, tag, 64-bit memory, table of typed references."""
    kinds = [b"\x00\x80\x01", b"\x01\x70\x01\x00\x10", b"\x02\x00\x01", b"\x03\x7f\x00", b"\x04\x00\x07", b"\x02\x04\x80\x80\x80\x80\x80\x01", b"\x01\x63\x70\x00\x01"]
    body = _leb(len(imports) if count is None else count)
    for i, (m, n) in enumerate(imports):
        body += _leb(len(m)) + m.encode() + _leb(len(n)) + n.encode() + kinds[i % len(kinds)]
    return b"\x00asm\x01\x00\x00\x00" + b"\x01" + _leb(3) + b"abc" + b"\x02" + _leb(len(body)) + body


def test_wasm(spark):
    many = [("env", f"f{i}") for i in range(50_100)]
    modules = {
        "a.wasm": _module([("env", "system"), ("net", "connect"), ("js", "log")]), "b.wasm": _module([]), "c.wasm": _module(many),
        "d.wasm": _module([("env", "x")], count=50_001), "e.wasm": _module([("env", "system")])[:-6], "f.wasm": b"\x00as", "g.txt": b"plain",
    }
    df = spark.createDataFrame([("r", k, bytearray(v)) for k, v in modules.items()], "repo_id string, path string, raw binary")
    got = {}
    for r in wasm.wasm_imports(df).collect():
        got.setdefault(r.path, []).append((r.module, r.name))
    assert got == {"a.wasm": [("env", "system"), ("net", "connect"), ("js", "log")], "c.wasm": many, "d.wasm": [("env", "x")]}
    found = sorted((r.path, r.rule_id, r.severity) for r in wasm.detect_wasm(df.where("path = 'a.wasm'")).collect())
    assert found == [("a.wasm", "A2", "critical"), ("a.wasm", "A3", "high"), ("a.wasm", "A4", "critical"), ("a.wasm", "A4", "high")]
    assert sorted((r.path, r.reason) for r in wasm.wasm_errors(df).collect()) == [("d.wasm", "it ends early"), ("e.wasm", "it ends early")]


def test_feed_files(spark, tmp_path):
    (tmp_path / "c2.txt").write_text("# list\n\n1.2.3.4\t9\n evil.example 3\n")
    assert sorted(r.host for r in feeds.load_c2(spark, str(tmp_path / "c2.txt")).collect()) == ["1.2.3.4", "evil.example"]
    (tmp_path / "osv.json").write_text('{"ecosystem":"npm","name":"a","body":"{\\"vulns\\":[{\\"id\\":\\"X-1\\",\\"details\\":\\"d\\"},{\\"id\\":\\"X-2\\"}]}"}\n{"ecosystem":"npm","name":"b","body":"{}"}\n')
    from palisade.operators.threat_joins import known_vulnerable

    deps = spark.createDataFrame([("r", "p", "npm", "a", "1"), ("r", "p", "npm", "b", "1")], "repo_id string, path string, ecosystem string, name string, version string")
    got = known_vulnerable(deps, feeds.load_advisories(spark, str(tmp_path / "osv.json"))).collect()
    assert sorted((r.advisory, r.summary, r.severity) for r in got) == [("X-1", "d", "unknown"), ("X-2", "", "unknown")]
    (tmp_path / "mb.json").write_text('{"sha256":"s1","body":"{\\"query_status\\":\\"ok\\",\\"data\\":[{\\"sha256_hash\\":\\"s1\\",\\"malware\\":\\"m\\"}]}"}\n{"sha256":"s2","body":"{\\"query_status\\":\\"hash_not_found\\"}"}\n')
    assert sorted((r.sha256, r.known, r.malware) for r in feeds.load_malware(spark, str(tmp_path / "mb.json")).collect()) == [("s1", True, "m"), ("s2", False, None)]


@pytest.mark.parametrize("name,kind", [("a/b.zip", "archive"), ("a/b.TAR", "archive"), ("zip", "file"), ("a.py", "file")])
def test_source_kind(spark, name, kind):
    assert spark.range(1).select(inventory.source_kind(F.lit(name))).first()[0] == kind
