"""Risk scores and the views on findings that reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.policy import Policy
from palisade.schema import GATE_SCORE, severity_sort

# Points per finding and the ceiling of the score.
POINTS = {"critical": 3.0, "high": 1.5, "medium": 0.5}
MAX_SCORE = 10.0

LEVELS = ("critical", "high", "medium", "low")


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    keys = by or ("repo_id",)
    return findings.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == level).alias(level) for level in LEVELS], F.count("*").alias("total")
    )


def score(counts: DataFrame) -> DataFrame:
    points = F.lit(0.0)
    for level, worth in POINTS.items():
        points = points + F.col(level) * worth
    worst = F.lit("info")
    for level in reversed(LEVELS):
        worst = F.when(F.col(level) > 0, level).otherwise(worst)
    return counts.withColumns({"score": F.least(F.lit(MAX_SCORE), points), "max_severity": worst})


def risk_score(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository, clean ones included with score 0. Counting is combined before the shuffle,
    so a repository that holds most findings costs no more than any other."""
    return _per_repo(severity_counts(findings), repos)


def _per_repo(counts: DataFrame, repos: DataFrame) -> DataFrame:
    extra = [c for c in counts.columns if c not in ("repo_id", *LEVELS, "total")]
    all_repos = repos.select("repo_id").distinct().join(counts, "repo_id", "left").na.fill(0, [*LEVELS, "total"])
    return score(all_repos).select("repo_id", "score", "max_severity", *LEVELS, "total", *extra)


def decide(findings: DataFrame, repos: DataFrame, policy: Policy | None = None, threshold: float = GATE_SCORE) -> DataFrame:
    """Risk and gate decision together: counts and the policy flag come from one aggregate over the findings."""
    violation = policy.is_violation() if policy is not None else F.lit(False)
    counts = findings.groupBy("repo_id").agg(
        *[F.count_if(F.col("severity") == level).alias(level) for level in LEVELS],
        F.count("*").alias("total"),
        F.bool_or(violation).alias("blocked"),
    )
    decided = _per_repo(counts, repos).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return decided.withColumn("failed", (F.col("score") >= threshold) | F.col("blocked"))


def decide_counts(counts: DataFrame, threshold: float = GATE_SCORE) -> DataFrame:
    """The gate from counts that already hold every repository; no policy, no join."""
    scored = score(counts).select("repo_id", "score", "max_severity", *LEVELS, "total")
    return scored.withColumns({"blocked": F.lit(False), "failed": F.col("score") >= threshold})


def with_severity_overrides(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Replace the severity of whole categories before scoring; optional, off by default."""
    if not overrides:
        return findings
    pairs = F.create_map(*[F.lit(x) for item in overrides.items() for x in item])
    return findings.withColumn("severity", F.coalesce(F.element_at(pairs, F.col("category")), F.col("severity")))


def gate(risk: DataFrame, blocked: DataFrame | None = None, threshold: float = GATE_SCORE) -> DataFrame:
    """Failed when the score reaches the threshold or policy blocks the repository."""
    if blocked is None:
        return risk.withColumns({"blocked": F.lit(False), "failed": F.col("score") >= threshold})
    flags = blocked.select("repo_id", "blocked")
    joined = risk.join(flags, "repo_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return joined.withColumn("failed", (F.col("score") >= threshold) | F.col("blocked"))


def report_order() -> list[Column]:
    return [severity_sort(F.col("severity")), F.coalesce("path", F.lit("")), F.coalesce("line_no", F.lit(0))]


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Severity, path, line: a range-partitioned total order."""
    return findings.orderBy(*report_order())


def shown_findings(findings: DataFrame, verbose: bool = False) -> DataFrame:
    """What the text report prints: no info, medium only on request; ordered within severities."""
    levels = ("critical", "high", "medium", "low") if verbose else ("critical", "high", "low")
    return ordered_findings(findings.where(F.col("severity").isin(*levels)))


def findings_by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", F.coalesce("path", F.lit("<unknown>")).alias("path")).agg(F.count("*").alias("n"))


def search_findings(findings: DataFrame, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Severity filter and case-insensitive substring search over path, title and description."""
    found = findings
    if severity:
        found = found.where(F.col("severity") == severity)
    if text:
        needle = F.lit(text.lower())
        hit = F.lit(False)
        for column in ("path", "title", "description"):
            hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), needle)
        found = found.where(hit)
    return found


def union_findings(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union of detector outputs."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
