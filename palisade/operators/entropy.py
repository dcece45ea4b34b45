"""High-entropy lines that may hide payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions.decode import strict_base64_text
from palisade.functions.text import explode_lines, is_meaningful, shannon_entropy, strip, truncate
from palisade.rules.base import text_files
from palisade.schema import as_findings

# Fixed values.
THRESHOLD = 5.5
HIGH_THRESHOLD = 6.0
MIN_LENGTH = 30
BASE64_SHAPE = r"^[A-Za-z0-9+/=]+\z"
# 45 different characters carry at most log2(45) < 5.5 bits, so fewer than 46 cannot reach the threshold.
# (This also makes a hex-only line, 22 characters at most, impossible.)
MIN_SYMBOLS = 46


def high_entropy_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, value, entropy; cheap tests come before the entropy."""
    value = strip(F.col("line"))
    lines = explode_lines(files.where(text_files() & (F.length("content") > 0))).where(F.length("line") >= MIN_LENGTH)
    shaped = lines.select("repo_id", "path", "line_no", value.alias("value")).where(
        (F.length("value") >= MIN_LENGTH) & F.col("value").rlike(BASE64_SHAPE)
    ).where(F.size(F.array_distinct(F.split("value", ""))) >= MIN_SYMBOLS)
    return shaped.withColumn("entropy", shannon_entropy(F.col("value"))).where(F.col("entropy") >= THRESHOLD)


def detect_entropy(files: DataFrame) -> DataFrame:
    decoded = strict_base64_text(F.col("value"))
    lines = high_entropy_lines(files).withColumn("decoded", decoded)
    readable = (
        F.col("decoded").isNotNull()
        & F.col("decoded").rlike("[A-Za-z]")
        & is_meaningful(F.col("decoded"), 10)
    )
    lines = lines.withColumn("readable", F.coalesce(readable, F.lit(False))).where(
        F.col("readable") | (F.col("entropy") >= HIGH_THRESHOLD)
    )
    shown = F.format_string("%.1f", "entropy")
    chars = F.length("value").cast("string")
    is_payload = F.col("readable")
    return as_findings(
        lines.select(
            "repo_id",
            "path",
            "line_no",
            F.when(is_payload, "E1").otherwise("E2").alias("rule_id"),
            F.when(is_payload, "high").otherwise("medium").alias("severity"),
            F.when(is_payload, "medium").otherwise("low").alias("confidence"),
            F.when(is_payload, "encoded_payload").otherwise("high_entropy").alias("category"),
            F.concat(
                F.when(is_payload, "High-entropy encoded string (entropy=").otherwise("High-entropy string (entropy="),
                shown, F.lit(")"),
            ).alias("title"),
            F.when(
                is_payload,
                F.concat(F.lit("Encoded string ("), chars, F.lit(" characters) which decodes to readable text")),
            )
            .otherwise(F.concat(F.lit("Dense string ("), chars, F.lit(" characters), perhaps a hidden payload")))
            .alias("description"),
            F.when(is_payload, truncate(F.col("decoded"), 300)).alias("decoded"),
            truncate(F.col("value"), 80).alias("raw_value"),
        ),
        "entropy",
    )
