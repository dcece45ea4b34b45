"""Policy rules over findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.schema import as_findings, severity_rank

# The built-in policy.
DEFAULT_THRESHOLD = "high"
DEFAULT_BLOCKED = [
    "c2_callback", "credential_theft", "ci_remote_exec",
    "behavioral_exfil", "encoded_payload",
]
DEFAULT_ALLOWED = [
    "node_modules/", ".git/", "__pycache__/",
    "vendor/", ".venv/", "dist/", "build/",
]
THRESHOLDS = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Policy:
    """Which categories block, from which severity on, and under which path prefixes nothing does.

    A policy is configuration of a few lines, so it enters plans as literals and needs no join.
    """

    severity_threshold: str = DEFAULT_THRESHOLD
    block_categories: Sequence[str] = tuple(DEFAULT_BLOCKED)
    allow_paths: Sequence[str] = tuple(DEFAULT_ALLOWED)

    def __post_init__(self) -> None:
        if self.severity_threshold not in THRESHOLDS:
            raise ValueError(f"severity_threshold must be one of {', '.join(THRESHOLDS)}, got {self.severity_threshold!r}")
        for name in ("block_categories", "allow_paths"):
            if isinstance(getattr(self, name), str) or not isinstance(getattr(self, name), Sequence):
                raise ValueError(f"{name} must be a list")

    def is_blocked(self, category: Column, path: Column) -> Column:
        """Category and path alone, whatever the severity."""
        allowed = F.lit(False)
        for prefix in self.allow_paths:
            allowed = allowed | F.startswith(path, F.lit(prefix))
        return ~allowed & category.isin(*self.block_categories)

    def is_violation(self) -> Column:
        severe = severity_rank(F.col("severity")) >= severity_rank(F.lit(self.severity_threshold))
        return self.is_blocked(F.col("category"), F.col("path")) & severe


def load_policy(spark: SparkSession, path: str) -> Policy:
    """Policy from a JSON object. Missing lists become empty (not the built-in ones), a missing threshold is "high"."""
    schema = "severity_threshold string, block_categories array<string>, allow_paths array<string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must hold one policy object")
    return policy_from_row(rows[0].asDict())


def policy_errors(policies: DataFrame) -> DataFrame:
    """policy_id, reason for each fault of stored policies (policy_id, body: a JSON object); sound ones give no row.

    The rules are those of ``Policy`` for one: a known threshold, and lists of texts; what is missing or null takes its preset.
    """
    parsed = policies.select("policy_id", F.expr("try_parse_json(body)").alias("v"))
    kind = lambda name: F.expr(f"schema_of_variant(try_variant_get(v, '$.{name}', 'variant'))")
    absent = lambda name: F.expr(f"is_variant_null(try_variant_get(v, '$.{name}', 'variant'))") | F.expr(f"try_variant_get(v, '$.{name}', 'variant')").isNull()
    whole = F.col("v").isNull() | ~F.startswith(F.coalesce(F.expr("schema_of_variant(v)"), F.lit("")), F.lit("OBJECT"))
    threshold = F.expr("try_variant_get(v, '$.severity_threshold', 'string')")
    checks = [F.when(whole, F.lit("it is no JSON object"))]
    known = (kind("severity_threshold") == "STRING") & F.coalesce(threshold.isin("", *THRESHOLDS), F.lit(False))
    checks.append(F.when(~whole & ~absent("severity_threshold") & ~known, F.lit("severity_threshold is unknown")))
    for name in ("block_categories", "allow_paths"):
        listed = kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")
        checks.append(F.when(~whole & ~absent(name) & ~listed, F.lit(f"{name} is no list of texts")))
    return parsed.select("policy_id", F.explode(F.array_compact(F.array(*checks))).alias("reason"))


def policy_from_row(values: dict) -> Policy:
    return Policy(
        values.get("severity_threshold") or DEFAULT_THRESHOLD,
        values.get("block_categories") or [],
        values.get("allow_paths") or [],
    )


def with_blocked_flag(findings: DataFrame, policy: Policy) -> DataFrame:
    return findings.withColumn("is_blocked", policy.is_blocked(F.col("category"), F.col("path")))


def policy_violations(findings: DataFrame, policy: Policy) -> DataFrame:
    """One critical violation per finding that is blocked and severe enough."""
    return as_findings(
        findings.where(policy.is_violation()).select(
            "repo_id",
            "path",
            F.lit("X1").alias("rule_id"),
            F.lit("critical").alias("severity"),
            F.lit("high").alias("confidence"),
            F.lit("policy_violation").alias("category"),
            F.lit("Policy violation: blocked category").alias("title"),
            F.concat(F.lit("Finding category '"), "category", F.lit("' is blocked by policy")).alias("description"),
            "attack_path",
            F.lit("Remove or quarantine the file.").alias("remediation"),
            "line_no",
        ),
        "policy",
    )


def policy_gate(findings: DataFrame, policy: Policy | None) -> DataFrame:
    """repo_id, blocked for every repository with findings; without a policy nothing is blocked."""
    hit = policy.is_violation() if policy is not None else F.lit(False)
    return findings.groupBy("repo_id").agg(F.bool_or(hit).alias("blocked"))
