"""File type deception: what the first bytes say against what the name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.schema import as_findings
from palisade.sources.files import IMAGE_EXTS, latin_head

# Signatures within the first bytes.
HEADER_BYTES = 100
SVG_SIGNATURE = r"(?i)<svg[\s>]"
XML_SIGNATURE = r"(?i)<\?xml\s+version"
JS_SIGNATURE = r"(?i)(?:function\s+\w+\s*\(|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=)"
HTML_SIGNATURE = r"(?i)<!DOCTYPE\s+html|<html[\s>]"
SCRIPT_SIGNATURE = r"(?i)<script[\s>]"


def detect_mime(files: DataFrame, raw: Column | None = None) -> DataFrame:
    """Runs on every non-empty file, whatever its type. ``raw`` defaults to the content's UTF-8 bytes."""
    if raw is None:
        raw = F.col("raw") if "raw" in files.columns else F.encode("content", "UTF-8")
    ext = F.coalesce(F.col("declared_ext"), F.lit(""))
    head = F.col("_head")
    image = ext.isin(*IMAGE_EXTS)

    def finding(rule_id: str, condition: Column, severity: str, confidence: str, category: str, what: str,
                description: Column, raw_value: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"),
                F.lit(confidence).alias("confidence"), F.lit(category).alias("category"),
                F.concat(F.lit("File has '"), ext, F.lit("' extension but contains " + what)).alias("title"),
                description.alias("description"), raw_value.alias("raw_value"),
            ),
        )

    none = F.lit(None).cast("string")
    checks = [
        finding("M1", image & (head.rlike(SVG_SIGNATURE) | head.rlike(XML_SIGNATURE)), "critical", "high",
                "mime_mismatch", "XML/SVG content",
                F.concat(F.lit("Named as an image ('"), ext, F.lit("') but the first bytes are XML or SVG.")),
                F.concat(F.lit("Declared: "), ext, F.lit(", Detected: XML/SVG"))),
        finding("M2", image & head.rlike(JS_SIGNATURE), "critical", "high", "polyglot_file", "JavaScript code",
                F.lit("Named as an image but the first bytes declare JavaScript."), none),
        finding("M3", ~ext.isin(".html", ".htm") & head.rlike(HTML_SIGNATURE), "high", "medium", "mime_mismatch",
                "HTML markup", F.lit("HTML under a name that does not say so."), none),
        finding("M4", ~ext.isin(".html", ".htm", ".svg", ".xml") & head.rlike(SCRIPT_SIGNATURE), "high", "medium",
                "polyglot_file", "<script> elements", F.lit("Script element in a file that is neither HTML nor SVG."), none),
    ]
    found = (
        files.select("repo_id", "path", "declared_ext", latin_head(raw, HEADER_BYTES).alias("_head"))
        .where("_head <> ''")
        .select("repo_id", "path", F.explode_outer(F.array(*checks)).alias("f"))
        .where("f is not null")
    )
    return as_findings(found.select("repo_id", "path", "f.*"), "mime_deception")
