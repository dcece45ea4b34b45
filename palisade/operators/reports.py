"""Report sinks: JSON lines, SARIF rows, summary.

A repository may own a third of all findings, so no report gathers a repository in one row or task: documents are stored
as text parts in order, which joined are valid JSON or SARIF.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from palisade.functions.text import truncate
from palisade.operators.joins import salted_join
from palisade.operators.scoring import report_order

TOOL, VERSION = "palisade", "0.1.0"

# Cuts in the JSON report; SARIF version, schema and levels.
JSON_CUTS = {"snippet": 300, "decoded": 500, "raw": 200}
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_LEVELS = {
    "critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none", "error": "error",
}

_FINDING_JSON = (
    "struct<file:string,severity:string,confidence:string,category:string,title:string,description:string,"
    "attack_path:string,remediation:string,line:int,snippet:string,decoded:string,raw:string>"
)
_KEEP_NULLS = {"ignoreNullFields": "false"}


def finding_struct() -> Column:
    return F.struct(
        F.col("path").alias("file"),
        "severity", "confidence", "category", "title", "description", "attack_path", "remediation",
        F.col("line_no").alias("line"),
        truncate(F.col("snippet"), JSON_CUTS["snippet"]).alias("snippet"),
        truncate(F.col("decoded"), JSON_CUTS["decoded"]).alias("decoded"),
        truncate(F.col("raw_value"), JSON_CUTS["raw"]).alias("raw"),
    )


def findings_json(findings: DataFrame) -> DataFrame:
    """repo_id, body: one JSON object per finding."""
    return findings.select("repo_id", F.to_json(finding_struct(), _KEEP_NULLS).alias("body"))


def parse_findings_json(lines: DataFrame) -> DataFrame:
    """The way back from JSON to finding columns."""
    f = F.from_json("body", _FINDING_JSON)
    return lines.select("repo_id", f.alias("f")).select(
        "repo_id", F.col("f.file").alias("path"), "f.severity", "f.confidence", "f.category", "f.title", "f.description",
        "f.attack_path", "f.remediation", F.col("f.line").alias("line_no"), "f.snippet", "f.decoded",
        F.col("f.raw").alias("raw_value"),
    )


def header_json(scans: DataFrame) -> DataFrame:
    """repo_id, body: the head of a report, one per scan."""
    risk = F.struct(
        F.round("score", 1).alias("score"), "max_severity", "critical", "high", "medium", "low", "total"
    )
    return scans.select(
        "repo_id",
        F.to_json(
            F.struct(
                F.col("repo_id").alias("target"),
                F.date_format("scan_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("scan_time"),
                F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("version"),
                F.col("files_count").alias("files_scanned"), risk.alias("risk_score"),
                "blocked", "analyzer_errors", "skipped_cache",
            ),
            _KEEP_NULLS,
        ).alias("body"),
    )


PLACE = ["section", "severity_place", "path_place", "line_place", "digest", "copy"]


def _placed(rows: DataFrame, section: int, order: list[Column] | None = None) -> DataFrame:
    """repo_id, body and the columns of PLACE, which order the parts of a document; equal parts are told apart by number."""
    keys = order or [F.lit(0), F.lit(""), F.lit(0)]
    digest = F.xxhash64("body")
    named = rows.select(
        "repo_id", "body", F.lit(section).alias("section"), keys[0].cast("int").alias("severity_place"),
        keys[1].alias("path_place"), keys[2].cast("int").alias("line_place"), digest.alias("digest"),
    )
    equal = Window.partitionBy("repo_id", *PLACE[:-1]).orderBy("body")
    return named.withColumn("copy", F.row_number().over(equal) if order else F.lit(1))


def _listed(rows: DataFrame) -> DataFrame:
    """Elements of a JSON array: all but a repository's first begin with a comma. The first is a minimum, not a sorted group."""
    first = rows.groupBy("repo_id").agg(F.min(F.struct(*PLACE)).alias("_first"))
    joined = salted_join(rows, first, ["repo_id"])
    body = F.when(F.struct(*PLACE) == F.col("_first"), F.col("body")).otherwise(F.concat(F.lit(","), "body"))
    return joined.withColumn("body", body).drop("_first")


def json_documents(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, PLACE, body: text parts that, joined in the order of PLACE, are one JSON document a repository."""
    head = header_json(scans).select("repo_id", F.concat(F.expr("left(body, length(body) - 1)"), F.lit(',"findings":[')).alias("body"))
    rows = findings.select("repo_id", F.to_json(finding_struct(), _KEEP_NULLS).alias("body"), *[k.alias(f"k{i}") for i, k in enumerate(report_order())])
    tail = scans.select("repo_id", F.lit("]}").alias("body"))
    middle = _listed(_placed(rows, 1, [F.col("k0"), F.col("k1"), F.col("k2")]))
    return _placed(head, 0).unionByName(middle).unionByName(_placed(tail, 2))


def sarif_documents(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """repo_id, PLACE, body: text parts that, joined in the order of PLACE, are one SARIF log a repository."""
    start = (
        '{"$schema":"' + SARIF_SCHEMA + '","version":"' + SARIF_VERSION + '","runs":[{"tool":{"driver":{"name":"' + TOOL
        + '","version":"' + VERSION + '","rules":['
    )
    properties = F.to_json(
        F.struct(F.col("repo_id").alias("target"), F.col("files_count").alias("files_scanned"), F.col("score").alias("risk_score"))
    )
    head = scans.select("repo_id", F.lit(start).alias("body"))
    between = scans.select("repo_id", F.concat(F.lit(']}},"properties":'), properties, F.lit(',"results":[')).alias("body"))
    tail = scans.select("repo_id", F.lit("]}]}").alias("body"))
    rules = sarif_rules(findings)
    listed = _listed(_placed(rules.select("repo_id", "body", "rule_index"), 1, [F.col("rule_index"), F.lit(""), F.lit(0)]))
    results = _listed(_placed(sarif_results(findings, rules), 3, [F.lit(0), F.lit(""), F.lit(0)]))
    return _placed(head, 0).unionByName(listed).unionByName(_placed(between, 2)).unionByName(results).unionByName(_placed(tail, 4))


def write_documents(parts: DataFrame, path: str, buckets: int = 64) -> None:
    """Store the parts of documents, in order, in a directory for each of so many buckets of repositories.

    Range partitioning on the sort key spreads a large repository over many files.
    """
    keys = ["bucket", "repo_id", *PLACE]
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(buckets)))
    bucketed.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_document(spark: SparkSession, path: str, repo_id: str, buckets: int = 64) -> Iterator[str]:
    """The text parts of one repository's document, in order, streamed to the caller."""
    bucket = F.pmod(F.xxhash64(F.lit(repo_id)), F.lit(buckets))
    rows = spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("repo_id") == repo_id))
    return (r.body for r in rows.orderBy(*PLACE).select("body").toLocalIterator())


def _level(severity: Column) -> Column:
    level = F.lit("warning")
    for name, value in SARIF_LEVELS.items():
        level = F.when(severity == name, value).otherwise(level)
    return level


def _sarif_id(category: Column) -> Column:
    return F.concat(F.lit("PAL-"), F.upper(category))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """repo_id, category, rule_index, body. A rule takes its texts from the first finding of its category in report
    order; indexes follow first appearance. Per repository only one row per category (36 at most) is ranked."""
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(report_order())], "title", "description")
    first = findings.groupBy("repo_id", "category").agg(
        F.min(F.struct(place.alias("place"), "severity", "confidence", "attack_path", "remediation")).alias("f")
    )
    by_place = Window.partitionBy("repo_id").orderBy("f.place", "category")
    body = F.to_json(
        F.struct(
            _sarif_id(F.col("category")).alias("id"),
            F.col("category").alias("name"),
            F.struct(F.col("f.place.title").alias("text")).alias("shortDescription"),
            F.struct(F.col("f.place.description").alias("text")).alias("fullDescription"),
            F.struct(_level(F.col("f.severity")).alias("level")).alias("defaultConfiguration"),
            F.struct("f.severity", "f.confidence", "f.attack_path", "f.remediation").alias("properties"),
        )
    )
    return first.withColumn("rule_index", F.row_number().over(by_place) - 1).select(
        "repo_id", "category", "rule_index", body.alias("body")
    )


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """repo_id, body: one SARIF result per finding. A region stands wherever a line or a snippet is known."""
    index = rules.select("repo_id", "category", "rule_index")
    snippet = F.when(F.col("snippet") != "", F.struct(F.col("snippet").alias("text")))
    line = F.when(F.col("line_no") > 0, F.col("line_no"))
    region = F.when(line.isNotNull() | snippet.isNotNull(), F.struct(line.alias("startLine"), snippet.alias("snippet")))
    message = F.when(F.col("description") != "", F.concat("title", F.lit(": "), "description")).otherwise(F.col("title"))
    location = F.struct(
        F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")
    )
    body = F.to_json(
        F.struct(
            _sarif_id(F.col("category")).alias("ruleId"),
            F.col("rule_index").alias("ruleIndex"),
            _level(F.col("severity")).alias("level"),
            F.struct(message.alias("text")).alias("message"),
            F.array(location).alias("locations"),
            F.when(F.col("decoded") != "", F.struct("decoded")).alias("properties"),
        )
    )
    return salted_join(findings, index, ["repo_id", "category"]).select("repo_id", body.alias("body"))


def sarif_rows(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """repo_id, section (run, rule, result), body: the parts of one SARIF log per repository."""
    rules = sarif_rules(findings)
    run = scans.select(
        "repo_id",
        F.lit("run").alias("section"),
        F.to_json(
            F.struct(
                F.lit(SARIF_SCHEMA).alias("$schema"),
                F.lit(SARIF_VERSION).alias("version"),
                F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version")).alias("driver"),
                F.struct(
                    F.col("repo_id").alias("target"), F.col("files_count").alias("files_scanned"),
                    F.col("score").alias("risk_score"),
                ).alias("properties"),
            )
        ).alias("body"),
    )
    return (
        run.unionByName(rules.select("repo_id", F.lit("rule").alias("section"), "body"))
        .unionByName(sarif_results(findings, rules).select("repo_id", F.lit("result").alias("section"), "body"))
    )


def summary_lines(risk: DataFrame) -> DataFrame:
    """The head of the text report, as columns."""
    return risk.select(
        "repo_id",
        F.concat(
            F.lit("RISK SCORE: "), F.format_string("%.1f", "score"), F.lit(" / 10.0  ("), "max_severity", F.lit(")")
        ).alias("score_line"),
        F.concat(
            F.col("critical").cast("string"), F.lit(" critical, "), F.col("high").cast("string"), F.lit(" high, "),
            F.col("medium").cast("string"), F.lit(" medium, "), F.col("low").cast("string"), F.lit(" low"),
        ).alias("count_line"),
        F.concat(F.lit("Total findings: "), F.col("total").cast("string")).alias("total_line"),
    )


