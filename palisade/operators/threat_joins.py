"""Joins of the inventory with threat feeds. The optimizer broadcasts a feed only where its size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.operators.joins import salted_join


def known_vulnerable(deps: DataFrame, advisories: DataFrame, match_version: bool = False) -> DataFrame:
    """Dependencies with their advisories.

    The version plays no part unless ``match_version`` is set, which needs an ``affected_versions`` array column.
    """
    condition = ["ecosystem", "name"]
    joined = salted_join(deps, advisories, condition)
    if match_version:
        joined = joined.where(F.array_contains("affected_versions", F.col("version")))
    serious = F.exists(
        "references",
        lambda r: F.contains(F.lower(r["url"]), F.lit("severity")) | F.contains(F.lower(r["url"]), F.lit("cve")),
    )
    return joined.select(
        "repo_id",
        "path",
        "ecosystem",
        "name",
        "version",
        F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.array_join("aliases", ", "))
        .otherwise(F.coalesce("id", F.lit("unknown")))
        .alias("advisory"),
        F.coalesce("summary", "details", F.lit("")).alias("summary"),
        F.when(serious, "high").otherwise("unknown").alias("severity"),
    )


def known_malware(files: DataFrame, malware: DataFrame) -> DataFrame:
    """Files whose content hash is listed as malware; a hash that a third of all files share is spread over several tasks."""
    listed = malware.where("known").select("sha256", "malware")
    return salted_join(files.select("repo_id", "path", "sha256"), listed, ["sha256"]).select("repo_id", "path", "sha256", "malware")


def known_c2(urls: DataFrame, c2: DataFrame) -> DataFrame:
    """URLs whose host stands on the command-host list; the list is made distinct so that no URL is repeated."""
    return salted_join(urls, c2.select("host").distinct(), ["host"], "left_semi")
