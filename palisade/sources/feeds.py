"""Threat feeds as reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import strip

# How long each feed stays fresh, in seconds.
TTL_SECONDS = {"advisories": 24 * 3600, "malware": 6 * 3600, "c2": 12 * 3600}

ADVISORY_JSON = (
    "struct<vulns:array<struct<id:string,aliases:array<string>,summary:string,details:string,"
    "references:array<struct<url:string>>>>>"
)
MALWARE_JSON = "struct<query_status:string,data:array<struct<sha256_hash:string,malware:string>>>"


def parse_c2_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Host list: blanks and # comments are skipped, the first token of a line is the host."""
    trimmed = strip(F.col(column))
    return lines.select(trimmed.alias("_line")).where("_line <> '' and not startswith(_line, '#')").select(
        F.get(F.split("_line", r"(?U)[\s\x1c-\x1f]+"), F.lit(0)).alias("host")
    )


def load_c2(spark: SparkSession, path: str) -> DataFrame:
    return parse_c2_lines(spark.read.text(path))


def flatten_advisories(answers: DataFrame, column: str = "body") -> DataFrame:
    """One row per advisory from lookup answers keyed by (ecosystem, name)."""
    parsed = answers.select("ecosystem", "name", F.from_json(column, ADVISORY_JSON)["vulns"].alias("vulns"))
    return parsed.select("ecosystem", "name", F.explode_outer("vulns").alias("v")).where("v is not null").select(
        "ecosystem", "name", "v.*"
    )


def load_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Text file of JSON lines {ecosystem, name, body}; ``body`` is the answer as JSON text."""
    return flatten_advisories(spark.read.schema("ecosystem string, name string, body string").json(path))


def flatten_malware(answers: DataFrame, column: str = "body") -> DataFrame:
    """sha256, malware per asked hash: the first entry of a positive answer; ``malware`` null for a remembered miss."""
    parsed = answers.select("sha256", F.from_json(column, MALWARE_JSON).alias("a"))
    hit = F.when(F.col("a.query_status") == "ok", F.get("a.data", F.lit(0)))
    return parsed.select("sha256", hit.isNotNull().alias("known"), hit["malware"].alias("malware"))


def load_malware(spark: SparkSession, path: str) -> DataFrame:
    return flatten_malware(spark.read.schema("sha256 string, body string").json(path))


def fresh(feed: DataFrame, ttl_seconds: int, as_of: Column) -> DataFrame:
    age = as_of.cast("timestamp").cast("double") - F.col("fetched_at").cast("timestamp").cast("double")
    return feed.where(age < ttl_seconds)


def upsert(feed: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """Newest row per key; at equal times a row of the update wins, then the largest values.

    One maximum over a struct combines before the shuffle, so a hot key needs no window.
    """
    values = [c for c in feed.columns if c not in key and c != "fetched_at"]
    both = feed.withColumn("_source", F.lit(0)).unionByName(update.withColumn("_source", F.lit(1)))
    newest = both.groupBy(*key).agg(F.max(F.struct("fetched_at", "_source", *values)).alias("_v"))
    return newest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in ["fetched_at", *values]])
