"""Registered queries of runs and streams: committed history, archives among files, a watched tree, changed versions."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.plans import oracle
from palisade.plans.oracle import q as lit_sql
from palisade.plans.queries import _COUNTS, TREE_PLACES, query
from palisade.plans.scan import NAMED, WIDE, run_scan, stored_scans
from palisade.plans.seeded import seeded_files
from palisade.rules import secrets
from palisade.rules.base import built_in_rules
from palisade.sources import files as inventory
from palisade.sources.ingest import with_members
from palisade.sources.tables import read_texts
from palisade.storage import run_folder
from palisade.streaming.changed_files import start_changed
from palisade.streaming.stream_scan import stream_tree, tree_findings

# ---- history of runs

SECRETS_ONLY = sorted(({r.analyzer for r in built_in_rules()} | {name for name, *_ in (*WIDE, *NAMED)} | {"wasm_analyzer"}) - {r.analyzer for r in secrets.RULES})


@query(
    "run_history",
    f"""WITH fi AS ({oracle.content_sql(secrets.RULES)}), cn AS (SELECT repo_id, {_COUNTS}, count(*) AS total FROM fi GROUP BY repo_id),
fc AS (SELECT source AS repo_id, count(*) AS files_count FROM documents GROUP BY source)
SELECT repo_id, scan_time, files_count, CAST(least(10.0, 3 * coalesce(critical, 0) + 1.5 * coalesce(high, 0) + 0.5 * coalesce(medium, 0)) AS DOUBLE) AS score,
 coalesce(critical, 0) AS critical, coalesce(total, 0) AS total, true AS timed
FROM fc LEFT JOIN cn USING (repo_id), (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-01-02')) t(scan_time)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of the seeded corpus, scanned on two days and each day twice: a repeated run adds nothing to the history."""
    out = run_folder(spark, "history")
    files = seeded_files(spark, sf).withColumn("sha256", F.sha2("content", 256))
    for day in ("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02"):
        run_scan(spark, files, out, F.lit(day).cast("timestamp"), skip=SECRETS_ONLY)
    scans, _ = stored_scans(spark, out)
    return scans.select("repo_id", "scan_time", "files_count", "score", "critical", "total", (F.col("duration_ms") > 0).alias("timed"))


# ---- trees


def write_tree(rows: DataFrame, root: str) -> None:
    """Files (path, body) under a root, written by tasks."""

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"]):
                full = f"{base}/{path}"
                system.create_dir(os.path.dirname(full), recursive=True)
                with system.open_output_stream(full, compression=None) as f:
                    f.write(bytes(body))
            yield batch[["path"]]

    rows.select("path", "body").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def _place(suffix: str) -> Column:
    places = F.get(F.array(*[F.lit(p) for p in TREE_PLACES]), (F.col("doc_id") % len(TREE_PLACES)).cast("int"))
    return F.concat("source", F.lit("/"), places, F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix))


_PLACE_SQL = f"[{', '.join(lit_sql(p) for p in TREE_PLACES)}][1 + doc_id % {len(TREE_PLACES)}]"


@query(
    "ingest_members",
    f"""WITH t AS (SELECT source, {_PLACE_SQL} AS place, doc_id, text FROM documents WHERE NOT contains({_PLACE_SQL}, 'node_modules'))
SELECT source AS repo_id, concat(place, '/', doc_id, '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM t WHERE doc_id % 3 > 0
UNION ALL SELECT concat(source, '!', place, '/', doc_id, '.zip'), m, octet_length(encode(text)), sha256(text) FROM t, (VALUES ('.env'), ('src/a.md')) v(m) WHERE doc_id % 3 = 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of the documents, every third one a zip of two copies: files and members make one inventory."""

    @F.pandas_udf("binary")
    def packed(texts):
        import io
        import zipfile

        def one(text):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for name in (".env", "src/a.md", "../out.txt", "dist/b.js"):
                    z.writestr(name, text)
            return buffer.getvalue()

        return texts.map(one)

    root = run_folder(spark, "tree")
    docs = read_texts(spark, sf, "documents", "doc_id", "source", "text")
    plain = docs.where("doc_id % 3 > 0").select(_place(".txt").alias("path"), F.encode("text", "UTF-8").alias("body"))
    write_tree(plain.unionByName(docs.where("doc_id % 3 = 0").select(_place(".zip").alias("path"), packed("text").alias("body"))), root)
    files = inventory.prepare_files(with_members(inventory.read_tree(spark, root)))
    return files.where(inventory.declared_ext(F.col("path")) != ".zip").select("repo_id", "path", "size", "sha256")


@query(
    "stream_tree",
    f"""WITH t AS (SELECT source AS repo_id, concat({_PLACE_SQL}, '/', doc_id, '.txt') AS path, CASE WHEN doc_id % 5 = 1 THEN concat(text, '!') ELSE text END AS body, doc_id FROM documents)
SELECT repo_id, path, CAST(octet_length(encode(body)) AS BIGINT) AS size, sha256(body) AS sha256 FROM t WHERE NOT contains(path, 'node_modules') AND doc_id % 7 <> 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A watched tree in two deliveries: half the documents first, then the rest, with some files changed and some deleted."""
    root, out = run_folder(spark, "tree"), run_folder(spark, "watched")
    docs = read_texts(spark, sf, "documents", "doc_id", "source", "text").withColumn("path", _place(".txt"))

    def look() -> None:
        stream_tree(spark, root, f"{out}/rows", f"{out}/checkpoint", None, lambda files: files.select("repo_id", "path", "size", "sha256")).awaitTermination()

    write_tree(docs.where("doc_id % 2 = 0 or doc_id % 7 = 2").select("path", F.encode("text", "UTF-8").alias("body")), root)
    look()
    changed = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    write_tree(docs.where("doc_id % 2 = 1 or doc_id % 5 = 1").select("path", F.encode(changed, "UTF-8").alias("body")), root)

    def remove(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for path in batch["path"]:
                if system.get_file_info(f"{base}/{path}").type != fs.FileType.NotFound:
                    system.delete_file(f"{base}/{path}")
            yield batch

    docs.where("doc_id % 7 = 2").select("path").mapInPandas(remove, "path string").write.format("noop").mode("overwrite").save()
    look()
    return tree_findings(spark, f"{out}/rows", f"{out}/checkpoint")


# ---- changed versions

_VERSIONS = """v AS (SELECT event_type AS repo_id, CAST(user_id AS VARCHAR) AS path, CAST(floor(value) AS BIGINT) % 3 AS size, ts AS seen FROM events),
w AS (SELECT *, lag(size) OVER o AS last_size, lag(seen) OVER o AS last_seen FROM v WINDOW o AS (PARTITION BY repo_id, path ORDER BY seen, size))"""


@query(
    "stream_changed_files",
    f"""WITH {_VERSIONS} SELECT repo_id, path, size, sha256(CAST(size AS VARCHAR)) AS sha256, seen FROM w
WHERE last_size IS NULL OR last_size <> size OR seen - last_seen > INTERVAL 2 DAY""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Events as versions of files, in two deliveries with a restart between: only changed or long unseen ones come out."""
    out = run_folder(spark, "versions")
    size = F.floor("value").cast("long") % 3
    versions = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_type").alias("repo_id"), F.col("user_id").cast("string").alias("path"), size.alias("size"),
        F.sha2(size.cast("string"), 256).alias("sha256"), F.col("ts").cast("timestamp").alias("seen"),
    )
    middle = F.lit("2024-01-16").cast("timestamp")
    for part in (versions.where(F.col("seen") < middle), versions.where(F.col("seen") >= middle)):
        part.write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(versions.schema).parquet(f"{out}/in")
        start_changed(spark, stream, f"{out}/changed", f"{out}/checkpoint", "r1", timedelta(days=2)).awaitTermination()
    return spark.read.parquet(f"{out}/changed")


