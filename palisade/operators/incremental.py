"""Scan only what is new: snapshot differences, result reuse, the ledger of scanned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from palisade.operators.joins import numbered, salted_join

# Fixed value: ledger rows kept per repository.
LEDGER_LIMIT = 1000

LEDGER_KEY = ["repo_id", "path", "size", "sha256"]


def only_changed(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Files named in ``changed`` (repo_id, path). None keeps all; an empty table keeps none."""
    if changed is None:
        return files
    return files.join(changed.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo_id, path, change (added, modified, deleted) between two snapshots compared by content hash.

    Presence has its own marks, so a file without a hash is neither new nor gone; two missing hashes count as equal.
    """
    before = old.select("repo_id", "path", F.lit(True).alias("_was"), F.col("sha256").alias("_old"))
    after = new.select("repo_id", "path", F.lit(True).alias("_is"), F.col("sha256").alias("_new"))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "deleted")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return (
        before.join(after, ["repo_id", "path"], "full_outer")
        .select("repo_id", "path", change.alias("change"))
        .where("change is not null")
    )


def diff_with_renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """``diff_snapshots`` with moves: repo_id, path, change, old_path.

    Within a repository, added and deleted files of equal content are paired one to one, the k-th added by path with the k-th
    deleted: ``renamed``, and the deletion goes. An added file that finds no partner but whose content stood in the old snapshot is
    ``copied`` from the first such path. Files without a hash only come and go. Numbers within a content are taken in ranges, so
    one content that most files share is many tasks' work.
    """
    diff = diff_snapshots(old, new)
    hashes = old.select("repo_id", "path", "sha256", F.lit("deleted").alias("change")).unionByName(
        new.select("repo_id", "path", "sha256", F.lit("added").alias("change"))
    )
    moved = numbered(diff.join(hashes, ["repo_id", "path", "change"]).where("sha256 is not null"), ["repo_id", "sha256", "change"], ["path"], "_k")
    key = ["repo_id", "sha256", "_k"]
    gone = moved.where("change = 'deleted'").select(*key, F.col("path").alias("old_path"))
    came = moved.where("change = 'added'").select(*key, "path")
    pairs = came.join(gone, key)
    renamed = pairs.select("repo_id", "path", F.lit("renamed").alias("change"), "old_path")
    first = old.where("sha256 is not null").groupBy("repo_id", "sha256").agg(F.min("path").alias("old_path"))
    copied = salted_join(came.join(pairs.select(*key), key, "left_anti").select("repo_id", "sha256", "path"), first, ["repo_id", "sha256"])
    copied = copied.select("repo_id", "path", F.lit("copied").alias("change"), "old_path")
    settled = renamed.unionByName(copied)
    explained = settled.select("repo_id", "path", F.lit("added").alias("change")).unionByName(
        renamed.select("repo_id", F.col("old_path").alias("path"), F.lit("deleted").alias("change"))
    )
    rest = diff.join(explained, ["repo_id", "path", "change"], "left_anti")
    return settled.unionByName(rest.withColumn("old_path", F.lit(None).cast("string")))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """What has to be scanned: added and modified files."""
    return diff_snapshots(old, new).where("change <> 'deleted'").select("repo_id", "path")


def split_cached(files: DataFrame, ledger: DataFrame, rules_version: str) -> tuple[DataFrame, DataFrame]:
    """(to scan, to reuse). A file is reused only if it is unchanged and was scanned with the same rules."""
    done = ledger.where(F.col("rules_version") == rules_version).select(*LEDGER_KEY).distinct()
    return files.join(done, LEDGER_KEY, "left_anti"), files.join(done, LEDGER_KEY, "left_semi")


def reused_findings(reused: DataFrame, findings: DataFrame) -> DataFrame:
    return findings.join(reused.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def ledger_rows(files: DataFrame, rules_version: str, scanned_at: Column) -> DataFrame:
    return files.select(*LEDGER_KEY, F.lit(rules_version).alias("rules_version"), scanned_at.alias("scanned_at"))


def prune_ledger(ledger: DataFrame, n: int | None = None, salts: int = 64) -> DataFrame:
    """The newest ``n`` rows of each repository; all of them without a limit (LEDGER_LIMIT is a preset).

    Ranks are taken twice: within salted parts of a repository, which leaves at most n rows per part, then over what is
    left. A repository with a third of all rows is thus ranked by many tasks first.
    """
    if n is None:
        return ledger
    order = [F.col("scanned_at").desc(), F.col("path"), F.col("sha256")]
    salt = F.pmod(F.xxhash64("path", "sha256"), F.lit(salts))
    part = Window.partitionBy("repo_id", "_salt").orderBy(*order)
    whole = Window.partitionBy("repo_id").orderBy(*order)
    return (
        ledger.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
