"""Registered queries: renames, look-alikes, similar names, multi-line steps, pages of a history, reports, rule selection, policies."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators import confusables, dependencies, history, incremental, policy, ranges, reports, run_blocks, scoring, similar_names
from palisade.operators.matching import match_content
from palisade.operators.unicode_tricks import KEYWORDS
from palisade.plans import oracle
from palisade.plans.oracle import cut
from palisade.plans.oracle import q as lit_sql
from palisade.plans.queries import (
    _DIFF, _JSON_FIELDS, _LEVEL, _RISK, _SCAN_KEEP, _SCANS, _SNAPSHOTS, ORACLE, SEEDED, _repos, _scans, _snapshots,
    _stored_findings, query,
)
from palisade.plans.queries_runs import SECRETS_ONLY
from palisade.plans.scan import register_detector, scan, unregister_detector
from palisade.plans.seeded import seeded_files
from palisade.rules import behavior, patterns, secrets
from palisade.rules.base import register_rules, registered_rules, select_rules, unregister_rules
from palisade.storage import run_folder

# ---- renames

_MOVES = f"""{_SNAPSHOTS.replace("FROM conversations)", "FROM conversations UNION ALL SELECT source, concat('moved/', doc_id), octet_length(encode(text)), sha256(text) FROM documents WHERE doc_id % 3 = 0)")},
{_DIFF},
h AS (SELECT d.repo_id, d.path, d.change, coalesce(n.sha256, o.sha256) AS sha256 FROM diff d LEFT JOIN new n ON d.change = 'added' AND n.repo_id = d.repo_id AND n.path = d.path
 LEFT JOIN old o ON d.change = 'deleted' AND o.repo_id = d.repo_id AND o.path = d.path WHERE d.change <> 'modified'),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, sha256, change ORDER BY path) AS k FROM h),
m AS (SELECT a.repo_id, a.path, g.path AS old_path FROM k a JOIN k g ON a.change = 'added' AND g.change = 'deleted' AND a.repo_id = g.repo_id AND a.sha256 = g.sha256 AND a.k = g.k),
c AS (SELECT a.repo_id, a.path, min(o.path) AS old_path FROM k a JOIN old o ON a.repo_id = o.repo_id AND a.sha256 = o.sha256
 WHERE a.change = 'added' AND (a.repo_id, a.path) NOT IN (SELECT (repo_id, path) FROM m) GROUP BY a.repo_id, a.path)
SELECT repo_id, path, 'renamed' AS change, old_path FROM m UNION ALL SELECT repo_id, path, 'copied', old_path FROM c
UNION ALL SELECT repo_id, path, change, NULL FROM diff WHERE NOT (change = 'added' AND ((repo_id, path) IN (SELECT (repo_id, path) FROM m) OR (repo_id, path) IN (SELECT (repo_id, path) FROM c)))
 AND NOT (change = 'deleted' AND (repo_id, path) IN (SELECT (repo_id, old_path) FROM m))"""


@query("diff_with_renames", f"WITH {_MOVES}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The two snapshots, the new one with a third of the old documents under other names too."""
    old, new = _snapshots(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0")
    moved = docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("moved/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"),
    )
    return incremental.diff_with_renames(old, new.unionByName(moved))


# ---- look-alikes

_FROM, _TO = lit_sql(confusables.IMITATIONS), lit_sql(confusables.IMITATED)


@query(
    "confusable_words",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", confusables.WORD, False, oracle.TEXT_GATE)], "f")}),
n AS (SELECT unnest([{", ".join(lit_sql(k) for k in KEYWORDS)}]) AS name UNION SELECT unnest(regexp_extract_all(text, '[a-z]+')) FROM benchmark)
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, matched AS word, name FROM occ JOIN n ON translate(matched, {_FROM}, {_TO}) = name WHERE matched <> name""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded corpus against the guarded keywords and all words of the benchmark table."""
    listed = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("name"))
    guarded = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in KEYWORDS])).alias("name"))
    return confusables.confusable_words(seeded_files(spark, sf), listed.unionByName(guarded)).select("repo_id", "path", "line_no", "word", "name")


# ---- similar names

_NAMES = """a AS (SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS w FROM documents WHERE lang = 'en')),
b AS (SELECT DISTINCT w AS popular FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS w FROM benchmark))"""
_SHARED = (
    "CAST(list_sum(list_transform(list_distinct(string_split(popular, '')), lambda c: least(length(name) - length(replace(name, c, '')), "
    "length(popular) - length(replace(popular, c, ''))))) AS INTEGER)"
)


@query(
    "similar_name_bounds",
    f"""WITH {_NAMES}, p AS (SELECT name, popular, {_SHARED} AS shared FROM a, b WHERE name <> popular
 AND 2 * least(length(name), length(popular)) >= {dependencies.MIN_RATIO} * (length(name) + length(popular)))
SELECT name, popular, shared FROM p WHERE 2 * shared >= {dependencies.MIN_RATIO} * (length(name) + length(popular))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents against words of the benchmark: every pair that may reach the ratio, by the index."""
    words = lambda table, pattern, name: spark.read.parquet(f"{sf}/{table}.parquet").select("*", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(name))  # noqa: E731, E501
    names = words("documents", "[a-z]{4,}", "name").where("lang = 'en'").select("name").distinct()
    return similar_names.bound_pairs(names, words("benchmark", "[a-z]{6,}", "popular").select("popular"))


# ---- steps of several lines

_RUNS = f"""{SEEDED},
l AS (SELECT repo_id, path, line_no, line, stripped AS text, regexp_matches(line, {lit_sql(run_blocks.HEAD)}) AS head, length(line) - length(ltrim(line, ' ')) AS indent,
  length(regexp_extract(line, {lit_sql(run_blocks.HEAD)}, 1)) AS own FROM ({oracle.lines_sql("f", oracle.WORKFLOW_GATE)})),
b AS (SELECT *, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY repo_id, path ORDER BY line_no) AS block FROM l),
e AS (SELECT b.*, max(CASE WHEN b.text <> '' AND b.indent <= h.own THEN 1 ELSE 0 END) OVER (PARTITION BY b.repo_id, b.path, b.block ORDER BY b.line_no) AS ended
  FROM b JOIN b h ON h.repo_id = b.repo_id AND h.path = b.path AND h.line_no = b.block WHERE NOT b.head),
r AS (SELECT repo_id, path, block AS line_no, count(*) AS n_lines, 'run: ' || replace(string_agg(text, ' && ' ORDER BY line_no), '\\ && ', '') AS command
  FROM (SELECT * FROM e WHERE ended = 0 AND text <> '') GROUP BY repo_id, path, block)"""


@query("run_blocks", f"{_RUNS} SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, CAST(n_lines AS INTEGER) AS n_lines, command FROM r")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return run_blocks.run_blocks(seeded_files(spark, sf))


@query(
    "run_block_findings",
    f"{_RUNS} " + " UNION ALL ".join(
        f"SELECT repo_id, path, {lit_sql(r.rule_id)} AS rule_id, {lit_sql(r.severity)} AS severity, CAST(line_no AS INTEGER) AS line_no, "
        f"concat({lit_sql(r.description)}, {cut('command', r.cut)}) AS description FROM r WHERE regexp_matches(command, {lit_sql('(?i)' + r.pattern)})"
        for r in run_blocks.RULES
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return run_blocks.detect_run_blocks(seeded_files(spark, sf)).select("repo_id", "path", "rule_id", "severity", "line_no", "description")


# ---- a page of a long history


@query("history_page", f"WITH {_SCANS} SELECT {_SCAN_KEEP} FROM sc WHERE max_severity = 'critical' ORDER BY scan_time DESC, scan_id LIMIT 40 OFFSET 25")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The history stored by month, read from the newest month on until the page is full."""
    out = run_folder(spark, "scans")
    history.append_scans(_scans(spark, sf).withColumn("scan_date", F.trunc("scan_time", "month")), out)
    return history.page_of_scans(spark, out, 40, 25, max_severity="critical").select(*_SCAN_KEEP.split(", "))


# ---- whole reports, part by part


def _section(column: str) -> str:
    return f"$.{column}"


@query(
    "json_report_fields",
    f"""WITH {_RISK}, x AS (SELECT repo_id, concat_ws('|', repo_id, printf('%.1f', score), max_severity, total) AS head, CAST(NULL AS VARCHAR) AS finding FROM rk
 UNION ALL SELECT repo_id, NULL, concat_ws('|', {", ".join(f"coalesce(CAST({e} AS VARCHAR), '-')" for _, e in _JSON_FIELDS)}) FROM fi)
SELECT repo_id, head, finding, count(*) AS n FROM x GROUP BY ALL
UNION ALL SELECT repo_id, 'commas', CAST(greatest(total - 1, 0) AS VARCHAR), 1 FROM rk""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON documents taken apart again: heads, findings, and one comma less than there are findings."""
    found = _stored_findings(spark, sf)
    scans = scoring.risk_score(found, _repos(spark, sf)).withColumns(
        {"scan_time": F.lit("2024-01-01 00:00:00").cast("timestamp"), "files_count": F.lit(0), "blocked": F.lit(False), "analyzer_errors": F.lit(0), "skipped_cache": F.lit(0)}
    )
    folder = run_folder(spark, "json")
    reports.write_documents(reports.json_documents(scans, found), folder)
    parts = spark.read.parquet(folder)
    get = lambda name: F.get_json_object("json", name)
    none = F.lit(None).cast("string")
    heads = parts.where("section = 0").withColumn("json", F.concat("body", F.lit("]}"))).select(
        "repo_id", F.concat_ws("|", get("$.target"), F.format_string("%.1f", get("$.risk_score.score").cast("double")), get("$.risk_score.max_severity"), get("$.risk_score.total")).alias("head"), none.alias("finding"),
    )
    middle = parts.where("section = 1").withColumn("json", F.regexp_replace("body", "^,", ""))
    findings = middle.select("repo_id", none.alias("head"), F.concat_ws("|", *[F.coalesce(get(_section(n)), F.lit("-")) for n, _ in _JSON_FIELDS]).alias("finding"))
    commas = parts.groupBy("repo_id").agg(F.count_if((F.col("section") == 1) & F.startswith("body", F.lit(","))).cast("string").alias("finding"))
    counted = heads.unionByName(findings).groupBy("repo_id", "head", "finding").agg(F.count("*").alias("n"))
    return counted.unionByName(commas.select("repo_id", F.lit("commas").alias("head"), "finding", F.lit(1).cast("long").alias("n")))


@query(
    "sarif_log_fields",
    f"""WITH {_RISK}, cats AS (SELECT repo_id, category FROM fi GROUP BY ALL)
SELECT repo_id, 'run' AS kind, '2.1.0' AS a, concat_ws('|', repo_id, printf('%.1f', score)) AS b, 1 AS n FROM rk
UNION ALL SELECT repo_id, 'rule', category, concat('PAL-', upper(category)), 1 FROM cats
UNION ALL SELECT repo_id, 'result', {_LEVEL}, concat_ws('|', concat('PAL-', upper(category)), path, coalesce(CASE WHEN line_no > 0 THEN CAST(line_no AS VARCHAR) END, '-')), count(*) FROM fi GROUP BY ALL
UNION ALL SELECT repo_id, 'commas', CAST(greatest(total - 1, 0) AS VARCHAR), CAST((SELECT greatest(count(*) - 1, 0) FROM cats WHERE cats.repo_id = rk.repo_id) AS VARCHAR), 1 FROM rk""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The SARIF logs taken apart again: run, rules, results, and the commas between them."""
    found = _stored_findings(spark, sf)
    scans = scoring.risk_score(found, _repos(spark, sf)).withColumn("files_count", F.lit(0))
    folder = run_folder(spark, "sarif")
    reports.write_documents(reports.sarif_documents(scans, found), folder)
    parts = spark.read.parquet(folder)
    get = lambda name: F.get_json_object("json", name)
    bare = parts.withColumn("json", F.regexp_replace("body", "^,", ""))
    start = parts.where("section = 0").select("repo_id", F.get_json_object(F.concat("body", F.lit("]}}}]}")), "$.version").alias("a"))
    between = parts.where("section = 2").withColumn("json", F.concat(F.lit("{"), F.regexp_extract("body", r'"properties":\{[^}]*\}', 0), F.lit("}")))
    risk = F.format_string("%.1f", get("$.properties.risk_score").cast("double"))
    run = start.join(between.select("repo_id", F.concat_ws("|", get("$.properties.target"), risk).alias("b")), "repo_id").select("repo_id", F.lit("run").alias("kind"), "a", "b")
    rules = bare.where("section = 1").select("repo_id", F.lit("rule").alias("kind"), get("$.name").alias("a"), get("$.id").alias("b"))
    place = "$.locations[0].physicalLocation"
    results = bare.where("section = 3").select(
        "repo_id", F.lit("result").alias("kind"), get("$.level").alias("a"),
        F.concat_ws("|", get("$.ruleId"), get(f"{place}.artifactLocation.uri"), F.coalesce(get(f"{place}.region.startLine"), F.lit("-"))).alias("b"),
    )
    listed = lambda section: F.count_if((F.col("section") == section) & F.startswith("body", F.lit(","))).cast("string")
    commas = parts.groupBy("repo_id").agg(listed(3).alias("a"), listed(1).alias("b")).select("repo_id", F.lit("commas").alias("kind"), "a", "b")
    rows = run.unionByName(rules).unionByName(results).groupBy("repo_id", "kind", "a", "b").agg(F.count("*").alias("n"))
    return rows.unionByName(commas.withColumn("n", F.lit(1).cast("long")))


# ---- selection of rules, registered rules and detectors

_FAST = [
    "dockerfile_lines", "dockerfile_absences", "cargo_manifest", "cargo_build_script", "python_setup", "python_pyproject", "workflow_lines",
    "workflow_self_hosted", "workflow_files", "workflow_reusable", "svg_xxe", "svg_scripts", "svg_attributes", "svg_obfuscated_lines",
    "unicode_invisible", "unicode_bidi", "unicode_homoglyphs", "unicode_file_names", "script_commands", "script_lifecycle",
    "script_url_dependencies", "dependency_rules", "dependency_hooks", "dependency_npm_lock", "dependency_pipfile_lock", "dependency_lines",
    "url_findings", "network_calls", "mime_deception",
]
_SLOW = ["patterns", "secrets", "entropy_lines"]
if any(r.slow for r in behavior.RULES):
    _SLOW.append("behavior")
else:
    _FAST.append("behavior")


def _counted(names: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT repo_id, rule_id, severity FROM ({ORACLE[n]})" for n in names)
    return f"SELECT repo_id, rule_id, severity, count(*) AS n FROM ({union}) GROUP BY ALL"


def _scan_counts(spark: SparkSession, sf: str, quick: bool) -> DataFrame:
    out = run_folder(spark, "files")
    seeded_files(spark, sf).write.parquet(out)
    found = scan(spark.read.parquet(out), quick=quick, focus_dir=run_folder(spark, "focus")).where("rule_id <> 'D3'")
    return found.groupBy("repo_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query("quick_scan_counts", _counted(_FAST))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A quick scan of the seeded corpus, all families at once; the similarity of names has no SQL and is left out."""
    return _scan_counts(spark, sf, True)


@query("full_scan_counts", _counted(_FAST + _SLOW))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scan_counts(spark, sf, False)


@query("selected_rules", oracle.content_sql([r for r in [*secrets.RULES, *patterns.RULES, *behavior.RULES] if r.analyzer != "yara" and not r.slow]))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Rules chosen by analyzer and quick mode, then run."""
    chosen = select_rules(skip=["YARA"], quick=True, rules=[*secrets.RULES, *patterns.RULES, *behavior.RULES])
    return match_content(seeded_files(spark, sf), chosen).select(
        "repo_id", "path", "rule_id", "severity", "confidence", "category", "title", "description", "line_no", "snippet", "decoded", "raw_value"
    )


_OWN = replace(patterns.RULES[0], rule_id="OWN1", pattern=r"nothing[ ]to\s+see|ring\w*", needles=("nothing", "ring"), severity="low", category="own", title="Own rule", description="Own: ", cut=20)


@query("registered_rules", f"SELECT repo_id, path, rule_id, severity, title, description, line_no FROM ({oracle.content_sql([_OWN])})")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A rule added by a user runs with the built-in ones; here those are skipped."""
    register_rules([_OWN])
    try:
        found = match_content(seeded_files(spark, sf), registered_rules())
    finally:
        unregister_rules(["OWN1"])
    return found.select("repo_id", "path", "rule_id", "severity", "title", "description", "line_no")


@query("registered_detector", f"{SEEDED} SELECT repo_id, path, 'long_text' AS analyzer, concat('Long: ', length(content)) AS title FROM f WHERE length(content) > 3000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A detector added by a user takes part in a scan."""

    def long_text(files: DataFrame) -> DataFrame:
        return files.where(F.length("content") > 3000).select("repo_id", "path", F.concat(F.lit("Long: "), F.length("content").cast("string")).alias("title"))

    register_detector("long_text", long_text)
    try:
        return scan(seeded_files(spark, sf), skip=[*SECRETS_ONLY, "secrets"]).select("repo_id", "path", "analyzer", "title")
    finally:
        unregister_detector("long_text")


# ---- huge texts


@query("content_by_ranges", oracle.content_sql([*behavior.RULES, *secrets.RULES]))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Behaviour and secret rules with ranges so short that most texts are cut."""
    return ranges.match_content_by_ranges(seeded_files(spark, sf), [*behavior.RULES, *secrets.RULES], range_chars=1024, overlap=256).select(
        "repo_id", "path", "rule_id", "severity", "confidence", "category", "title", "description", "line_no", "snippet", "decoded", "raw_value"
    )


# ---- policies


@query(
    "policy_errors",
    """WITH p AS (SELECT event_id AS policy_id, event_type, user_id, value FROM events),
x AS (SELECT policy_id, CASE event_type WHEN 'click' THEN 'severity_threshold is unknown' END AS a,
 CASE WHEN user_id % 3 = 0 THEN 'block_categories is no list of texts' END AS b, CASE WHEN value > 20 THEN 'allow_paths is no list of texts' END AS c FROM p WHERE event_type <> 'error')
SELECT policy_id, a AS reason FROM x WHERE a IS NOT NULL UNION ALL SELECT policy_id, b FROM x WHERE b IS NOT NULL UNION ALL SELECT policy_id, c FROM x WHERE c IS NOT NULL
UNION ALL SELECT policy_id, 'it is no JSON object' FROM p WHERE event_type = 'error'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A stored policy for each event, sound and faulty ones."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    threshold = F.when(F.col("event_type") == "click", F.lit('"severe"')).when(F.col("event_type") == "view", F.lit('"high"')).otherwise(F.lit("null"))
    blocked = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]')))
    allowed = F.when(F.col("value") > 20, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]"))).otherwise(F.lit("[]"))
    whole = F.concat(F.lit('{"severity_threshold":'), threshold, F.lit(',"block_categories":'), blocked, F.lit(',"allow_paths":'), allowed, F.lit("}"))
    body = F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).otherwise(whole)
    return policy.policy_errors(events.select(F.col("event_id").alias("policy_id"), body.alias("body")))


