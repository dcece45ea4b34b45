"""The whole scan: every family over one inventory, then risk, policy and history tables."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators import entropy, families, mime, scripts, svg, unicode_tricks, urls, wasm
from palisade.operators.advice import with_advice
from palisade.operators.dependencies import DEPENDENCY_FILES, detect_deps, manifest_errors
from palisade.operators.history import (
    SCANS, TAGS, commit_run, committed_runs, delete_scans, of_committed_runs, read_or_empty, redact, scan_rows, tag_rows, write_run_part,
)
from palisade.operators.incremental import ledger_rows, reused_findings, split_cached
from palisade.operators.matching import match_content, match_lines
from palisade.operators.policy import Policy
from palisade.operators.scoring import decide, union_findings
from palisade.rules import docker, workflows
from palisade.rules.base import LineRule, Rule, limited, named, registered_rules, rules_version, select_rules
from palisade.schema import as_findings
from palisade.sources.archives import ArchiveLimits
from palisade.sources.files import inventory_totals, left_out, unreadable
from palisade.sources.ingest import archive_members

Detector = Callable[[DataFrame], DataFrame]

# Families that need more than rule rows: analyzer name, priority, slow, function. The first list looks at files of any
# name, the second only at files its names single out.
WIDE: list[tuple[str, int, bool, Detector]] = [
    ("mime_deception", 5, False, mime.detect_mime),
    ("unicode", 15, False, unicode_tricks.detect_unicode),
    ("entropy", 35, True, entropy.detect_entropy),
    ("url_network", 40, False, urls.detect_urls),
]
NAMED: list[tuple[str, int, bool, Detector]] = [
    ("svg_vector", 10, False, svg.detect_svg),
    ("script_analyzer", 20, False, scripts.detect_scripts),
    ("dockerfile_analyzer", 22, False, families.detect_dockerfile_absences),
    ("dependency", 25, False, detect_deps),
    ("cargo", 28, False, families.detect_cargo_manifest),
    ("workflow", 30, False, families.detect_workflow_files),
    ("workflow", 30, False, families.detect_reusable_workflows),
]


def named_files(files: DataFrame) -> DataFrame:
    """Files that a family picks by name: manifests, lock files, scripts, pipelines, pictures."""
    wanted = svg.GATE() | scripts.GATE() | workflows.GATE() | docker.GATE()
    return files.where(wanted | named(*DEPENDENCY_FILES)() | named("cargo.toml", "build.rs", "setup.py", "pyproject.toml")())


_USER_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Add a detector that a rule row cannot express: files in, findings columns out."""
    _USER_DETECTORS[name] = detector


def unregister_detector(name: str) -> None:
    _USER_DETECTORS.pop(name, None)


def scan(files: DataFrame, skip: Iterable[str] = (), quick: bool = False, focus_dir: str | None = None,
         limits: dict[str, int] | None = None) -> DataFrame:
    """Findings of all families.

    ``limits`` (analyzer to bytes, such as ``schema.ANALYZER_LIMITS``) keeps larger files from an analyzer; ``scan_errors``
    reports them. Without it no file is left out.

    Content rules of all families share one pass over the texts; invisible characters, dense lines, URLs and file heads
    take one each. Everything else concerns files picked by name. With ``focus_dir`` these few are written there once and
    their families read that table, so the corpus is read six times however many families there are.
    Nothing is shuffled but first-occurrence and look-alike-name aggregates.
    """
    skipped = {s.lower() for s in skip}
    limits = limits or {}
    rules = [replace(r, gate=limited(r.gate, limits[r.analyzer])) if r.analyzer in limits else r for r in select_rules(skipped, quick)]
    content_rules = [r for r in rules if isinstance(r, Rule)]
    own_lines = {r.rule_id for r in registered_rules()}
    line_rules = [r for r in rules if isinstance(r, LineRule)]
    focus = named_files(files)
    if focus_dir is not None:
        focus.write.mode("overwrite").parquet(focus_dir)
        focus = files.sparkSession.read.parquet(focus_dir)
    parts = []
    if content_rules:
        parts.append(match_content(files, content_rules))
    for source, chosen in (
        (focus, [r for r in line_rules if r.rule_id not in own_lines]),
        (files, [r for r in line_rules if r.rule_id in own_lines]),
    ):
        if chosen:
            parts.append(match_lines(source, chosen))
    for source, families_ in ((files, WIDE), (focus, NAMED)):
        for name, _, slow, detect in families_:
            if name not in skipped and not (quick and slow):
                parts.append(detect(source.where(F.col("size") < limits[name]) if name in limits else source))
    if "raw" in files.columns and "wasm_analyzer" not in skipped:
        parts.append(wasm.detect_wasm(files))
    for name, detect in _USER_DETECTORS.items():
        if name.lower() not in skipped:
            parts.append(as_findings(detect(files), name))
    return with_advice(union_findings(*parts))


def scan_errors(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """repo_id, path, stage, reason of what a scan could not look at: missing bytes, limits, damaged modules, odd manifests."""
    parts = [left_out(files, most - 1, name) for name, most in (limits or {}).items()]
    parts.append(manifest_errors(files).select("repo_id", "path", F.lit("manifest").alias("stage"), F.lit("install hook is no text").alias("reason")))
    if "raw" in files.columns:
        parts += [unreadable(files), wasm.wasm_errors(files)]
    return union_findings(*parts)


def analyzer_errors(errors: DataFrame) -> DataFrame:
    """Errors per repository: the counter of a scan header."""
    return errors.groupBy("repo_id").agg(F.count("*").alias("analyzer_errors"))


def run_scan(spark: SparkSession, files: DataFrame, out: str, scan_time: Column, policy: Policy | None = None,
             quick: bool = False, skip: Iterable[str] = (), limits: dict[str, int] | None = None, tags: Column | None = None,
             expand: bool = True, archive_limits: ArchiveLimits | None = None) -> DataFrame:
    """Scan what is new, keep a history under ``out``, and return the gate decision per repository.

    ``files`` are prepared files with sha256. With ``expand``, archives among them whose bytes are there are opened, and their
    members are scanned as files of the repository "repo!archive". The inventory is written once; everything else reads that
    table. Files whose content and rules are those of the last committed run take their findings from it.

    Every table of a run is written under names of its own, and one row in ``commits``, written last, makes them visible
    together. A run that is cut off anywhere leaves nothing that a reader sees, and can be repeated. A run is known by its time and
    rules: repeating a committed one writes nothing and returns its decision.
    """
    started = time.monotonic()
    micros = spark.range(1).select(F.unix_micros(scan_time.cast("timestamp"))).first()[0]
    scan_time = F.timestamp_micros(F.lit(micros))
    version = rules_version(detectors=_USER_DETECTORS) + ("-quick" if quick else "") + "".join(f"-{s}" for s in sorted(skip))
    version += "".join(f"-{k}<{v}" for k, v in sorted((limits or {}).items())) + ("" if expand else "-closed")
    run_key = hashlib.sha256(f"{micros}|{version}".encode()).hexdigest()[:16]
    newest = committed_runs(spark, out).orderBy(F.desc("run"))
    done = newest.where(F.col("run_key") == run_key).first()
    if done is not None:
        return spark.read.parquet(f"{out}/runs/run={done.run}/decided")
    last = newest.first()
    run = last.run + 1 if last is not None else 1
    step = f"{out}/runs/run={run}"
    if expand and "raw" in files.columns:
        files = files.unionByName(archive_members(files, archive_limits), allowMissingColumns=True)
    files.write.mode("overwrite").parquet(f"{step}/files")
    files = spark.read.parquet(f"{step}/files")
    fresh, kept = files, None
    if last is not None:
        fresh, reused = split_cached(files, spark.read.parquet(f"{out}/ledger/version={last.run}"), version)
        kept = reused_findings(reused, spark.read.parquet(f"{out}/findings/version={last.run}"))
    found = scan(fresh, skip, quick, f"{step}/focus", limits)
    found = found if kept is None else union_findings(found, kept)
    found.write.mode("overwrite").parquet(f"{out}/findings/version={run}")
    findings = spark.read.parquet(f"{out}/findings/version={run}")
    ledger_rows(files.where("sha256 is not null"), version, scan_time).write.mode("overwrite").parquet(f"{out}/ledger/version={run}")
    scan_errors(files, limits).write.mode("overwrite").parquet(f"{step}/errors")
    decide(findings, files, policy).write.mode("overwrite").parquet(f"{step}/decided")
    decided = spark.read.parquet(f"{step}/decided")
    redact(findings).write.mode("overwrite").parquet(f"{step}/history")
    duration = int(1000 * (time.monotonic() - started))
    rows = scan_rows(decided, scan_time, inventory_totals(files), F.lit(duration))
    write_run_part(rows, f"{out}/scans", run_key, "scan_date")
    if tags is not None:
        write_run_part(tag_rows(rows, tags), f"{out}/scan_tags", run_key)
    commit_run(spark, out, run, run_key, scan_time, version, duration)
    return decided


def stored_findings(spark: SparkSession, out: str) -> DataFrame | None:
    """Findings of the last committed run; None before the first."""
    last = committed_runs(spark, out).orderBy(F.desc("run")).first()
    return None if last is None else spark.read.parquet(f"{out}/findings/version={last.run}")


def stored_scans(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Scans and tags of committed runs, without deleted ones."""
    scans, tags = of_committed_runs(spark, out, "scans", SCANS), of_committed_runs(spark, out, "scan_tags", TAGS)
    return delete_scans(scans, tags, read_or_empty(spark, f"{out}/deleted", "scan_id string"))


def delete_stored_scans(spark: SparkSession, out: str, doomed: DataFrame) -> None:
    """Delete scans (scan_id) from a stored history.

    The ids are appended to a table of deletions that every reader of the history joins away: nothing that others read is
    rewritten, and the history stays append-only.
    """
    doomed.select("scan_id").write.mode("append").parquet(f"{out}/deleted")
