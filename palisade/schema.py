"""Column layouts and closed value lists shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The vocabulary of findings.
SEVERITIES = ("critical", "high", "medium", "low", "info", "error")
CONFIDENCES = ("high", "medium", "low")

# A preset of limits for those who want them. Without a limit nothing is left out; whatever a limit leaves out
# is reported by ``left_out`` or ``scan_errors``.
INVENTORY_MAX_BYTES = 10 * 1024 * 1024
READ_MAX_MB = 2.0
ANALYZER_LIMITS = {"unicode": 500_000, "yara": 1_000_000, "url_network": 2_000_000, "behavioral": 2_000_000, "entropy": 2_000_000}
ERRORS = "repo_id string, path string, stage string, reason string"
GATE_SCORE = 7.0

FILE_KEY = ["repo_id", "path"]

FILES = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("raw", T.BinaryType()),
    ]
)

FINDINGS = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("analyzer", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("attack_path", T.StringType()),
        T.StructField("remediation", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("raw_value", T.StringType()),
    ]
)


def severity_sort(severity: Column) -> Column:
    """Report order: critical first, error last, anything else after it."""
    order = F.lit(99)
    for position, name in reversed(list(enumerate(SEVERITIES))):
        order = F.when(severity == name, position).otherwise(order)
    return order


def severity_rank(severity: Column) -> Column:
    """Policy order: info 0 up to critical 4; an unknown word counts as medium."""
    ranks = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    rank = F.lit(2)
    for name, value in ranks.items():
        rank = F.when(F.lower(severity) == name, value).otherwise(rank)
    return rank


def as_findings(df: DataFrame, analyzer: str | None = None) -> DataFrame:
    """Bring any detector output to the findings layout, filling absent columns with nulls."""
    present = set(df.columns)
    columns = []
    for field in FINDINGS.fields:
        value = field.name if field.name in present else "NULL"
        if field.name == "analyzer" and analyzer is not None:
            value = f"'{analyzer}'"
        columns.append(f"CAST({value} AS {field.dataType.simpleString()}) AS {field.name}")
    return df.selectExpr(*columns)
