"""Registered queries: each operator over the driver tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions import decode, unicode
from palisade.functions.text import (
    context, explode_lines, file_name, find_all, is_meaningful, shannon_entropy, truncate,
)
from palisade.operators import (
    dependencies, entropy, families, history, incremental, mime, policy, reports, scoring, scripts, svg, threat_joins,
    unicode_tricks, urls, wasm,
)
from palisade.operators.matching import match_content, match_lines, severity_counts_of
from palisade.plans import oracle
from palisade.plans.oracle import cut, in_list
from palisade.plans.oracle import q as lit_sql
from palisade.plans.scan import scan
from palisade.plans.seeded import seeded_files, seeded_sql
from palisade.rules import behavior, builds, docker, patterns, secrets, workflows
from palisade.rules.base import rules_version, select_rules
from palisade.sources import archives, feeds
from palisade.sources import files as inventory
from palisade.sources.tables import conversations_as_files, corpus_as_files, documents_as_files, pages_as_files, read_texts
from palisade.storage import run_folder
from palisade.streaming.stream_scan import stream_scan, streamed_findings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


FINDING_COLUMNS = [
    "repo_id", "path", "rule_id", "severity", "confidence", "category", "title", "description", "line_no", "snippet",
    "decoded", "raw_value",
]


def detector(name: str, detect: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A detector family over the seeded corpus."""
    query(name, sql)(lambda spark, sf: detect(seeded_files(spark, sf)).select(*FINDING_COLUMNS))


SEEDED = f"WITH f AS ({seeded_sql()})"
DOCS = "SELECT source AS repo_id, concat('docs/', lang, '/', doc_id, '.txt') AS path, text AS content FROM documents"
CORPUS = f"""{DOCS}
UNION ALL SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), concat('pages/', page_id, '.html'), html FROM pages
UNION ALL SELECT role, concat('conv/', conv_id, '/', turn, '.md'), text FROM conversations"""

# ---- detector families

detector("behavior", families.detect_behavior, oracle.content_sql(behavior.RULES))
detector("patterns", families.detect_patterns, oracle.content_sql(patterns.RULES))
detector("secrets", families.detect_secrets, oracle.content_sql(secrets.RULES))
detector("dockerfile_lines", families.detect_dockerfile_lines, oracle.line_rules_sql(docker.LINE_RULES))
detector("dockerfile_absences", families.detect_dockerfile_absences, oracle.dockerfile_absence_sql())
detector("cargo_manifest", families.detect_cargo_manifest, oracle.cargo_manifest_sql())
detector("cargo_build_script", lambda f: match_content(f, builds.BUILD_RS_RULES), oracle.content_sql(builds.BUILD_RS_RULES))
detector("python_setup", lambda f: match_lines(f, builds.PYTHON_LINE_RULES), oracle.line_rules_sql(builds.PYTHON_LINE_RULES))
detector("python_pyproject", lambda f: match_content(f, builds.PYPROJECT_RULES), oracle.content_sql(builds.PYPROJECT_RULES))
detector("workflow_lines", lambda f: match_lines(f, workflows.LINE_RULES), oracle.line_rules_sql(workflows.LINE_RULES))
detector("workflow_self_hosted", lambda f: match_content(f, workflows.RULES), oracle.content_sql(workflows.RULES))
detector("workflow_files", families.detect_workflow_files, oracle.workflow_file_sql())
detector("workflow_reusable", families.detect_reusable_workflows, oracle.reusable_sql())
detector("svg_xxe", svg.external_entities, oracle.svg_xxe_sql())
detector("svg_scripts", svg.script_findings, oracle.svg_scripts_sql())
detector("svg_attributes", svg.attribute_findings, oracle.svg_attributes_sql())
detector("svg_obfuscated_lines", svg.obfuscated_lines, oracle.svg_lines_sql())
detector("unicode_invisible", unicode_tricks.invisible_characters, oracle.invisible_sql())
detector("unicode_bidi", unicode_tricks.bidi_overrides, oracle.bidi_sql())
detector("unicode_homoglyphs", unicode_tricks.homoglyphs, oracle.homoglyph_sql())
detector("unicode_file_names", unicode_tricks.suspicious_file_names, oracle.file_names_sql())
detector("script_commands", scripts.command_findings, oracle.commands_sql())
detector("script_commands_strict", lambda f: scripts.command_findings(f, strict_case=True), oracle.commands_sql(ignore_case=False))
detector("script_lifecycle", scripts.lifecycle_findings, oracle.lifecycle_sql())
detector("script_url_dependencies", scripts.url_dependency_findings, oracle.url_dependencies_sql())
detector("dependency_rules", lambda f: dependencies.dependency_findings(dependencies.npm_deps(f)), oracle.dependency_rules_sql())
detector("dependency_hooks", dependencies.hook_findings, oracle.hooks_sql())
detector("dependency_npm_lock", dependencies.npm_lock_findings, oracle.npm_lock_sql())
detector("dependency_pipfile_lock", dependencies.pipfile_lock_findings, oracle.pipfile_lock_sql())
detector("dependency_lines", dependencies.line_findings, oracle.dependency_lines_sql())
detector("dependency_typosquat", lambda f: dependencies.typosquat_findings(dependencies.npm_deps(f)), None)
detector("url_findings", urls.detect_urls, oracle.urls_sql())
detector("network_calls", urls.detect_network_calls, oracle.network_calls_sql())
detector("entropy_lines", entropy.detect_entropy, oracle.entropy_sql())
detector(
    "mime_deception", mime.detect_mime,
    oracle.mime_sql(f"SELECT repo_id, path, content, {oracle.DECLARED} AS declared FROM ({seeded_sql()})"),
)


@query(
    "mime_deception_pages",
    oracle.mime_sql(
        "SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS repo_id, concat('pages/', page_id, '.png') AS path, "
        "html AS content, '.png' AS declared FROM pages"
    ),
)
def _(spark, sf):
    return mime.detect_mime(pages_as_files(spark, sf, ".png")).select(*FINDING_COLUMNS)


@query("npm_dependencies", oracle.npm_deps_sql())
def _(spark, sf):
    return dependencies.npm_deps(seeded_files(spark, sf))


@query(
    "npm_lock_packages",
    f"""WITH f AS ({seeded_sql()}),
p AS (SELECT repo_id, path, content, unnest(json_keys(content, '$.packages')) AS package FROM f WHERE name = 'package-lock.json')
SELECT repo_id, path, package, list_extract(string_split(package, 'node_modules/'), -1) AS name,
 content ->> ('$.packages."' || package || '".resolved') AS resolved, content ->> ('$.packages."' || package || '".integrity') AS integrity
FROM p WHERE package <> ''""",
)
def _(spark, sf):
    return dependencies.npm_lock_packages(seeded_files(spark, sf))


@query("extract_urls", oracle.extract_urls_sql())
def _(spark, sf):
    return urls.extract_urls(seeded_files(spark, sf))


@query("url_parts", oracle.url_parts_sql())
def _(spark, sf):
    return urls.with_url_parts(urls.distinct_urls(urls.extract_urls(seeded_files(spark, sf))))


# ---- sources


@query(
    "adapter_documents",
    f"SELECT repo_id, path, octet_length(encode(content)) AS size, md5(content) AS digest, true AS is_text FROM ({DOCS})",
)
def _(spark, sf):
    return documents_as_files(spark, sf).select("repo_id", "path", "size", F.md5("content").alias("digest"), "is_text")


@query(
    "adapter_corpus",
    f"SELECT repo_id, count(*) AS total_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS total_size FROM ({CORPUS}) GROUP BY repo_id",
)
def _(spark, sf):
    return inventory.inventory_totals(corpus_as_files(spark, sf))


# Places of a file in its repository, hidden and ignored ones among them.
TREE_PLACES = [".github/workflows", "src", "_private", "node_modules/x", ".hidden/deep"]


@query(
    "read_tree",
    f"""WITH t AS (SELECT source AS repo_id, concat([{", ".join(lit_sql(p) for p in TREE_PLACES)}][1 + doc_id % {len(TREE_PLACES)}], '/', doc_id, '.txt') AS path, text FROM documents)
SELECT repo_id, path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256, true AS is_text FROM t WHERE NOT contains(path, 'node_modules')""",
)
def _(spark, sf):
    """The documents written as files of a repository for each source, then read back as an inventory."""
    root = run_folder(spark, "tree")
    places = F.get(F.array(*[F.lit(p) for p in TREE_PLACES]), (F.col("doc_id") % len(TREE_PLACES)).cast("int"))
    docs = read_texts(spark, sf, "documents", "doc_id", "source", "text").select("source", F.concat(places, F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")

    def write(batches):
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for source, path, text in zip(batch["source"], batch["path"], batch["text"]):
                full = f"{base}/{source}/{path}"
                system.create_dir(os.path.dirname(full), recursive=True)
                with system.open_output_stream(full, compression=None) as f:
                    f.write(text.encode())
            yield batch[["path"]]

    docs.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return inventory.prepare_files(inventory.read_tree(spark, root)).select("repo_id", "path", "size", "sha256", "is_text")


@query("read_single_file")
def _(spark, sf):
    """The stored table itself as a file: its bytes by ranges, a digest of each."""
    ranges = inventory.read_ranges(spark, f"{sf}/documents.parquet", "tables")
    return ranges.withColumns({"kind": inventory.source_kind(F.col("path")), "length": F.octet_length("raw"), "sha256": F.sha2("raw", 256)}).drop("raw")


@query(
    "ignore_filter",
    f"""{SEEDED} SELECT repo_id, path FROM f
WHERE NOT list_has_any(string_split(path, '/'), [{", ".join(lit_sql(d) for d in inventory.IGNORED_DIRS)}])
  AND {oracle.DECLARED} NOT IN ({", ".join(lit_sql(e) for e in inventory.IGNORED_EXTS)})""",
)
def _(spark, sf):
    return inventory.filter_ignored(seeded_files(spark, sf)).select("repo_id", "path")


# Shapes that archive member names take, safe and unsafe.
NAME_SHAPES = ["{}/a.txt", "../{}", "/{}", "c:{}", "a/../{}", "a/..b/{}.md", "dist/{}", "lib/{}.so", "x/{}.d/y.py"]
_SHAPES_SQL = ", ".join(f"({lit_sql(s)})" for s in NAME_SHAPES)


def _shaped_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shapes = F.explode(F.array(*[F.lit(s) for s in NAME_SHAPES])).alias("shape")
    return docs.select("source", "doc_id", shapes).select(
        F.col("source").alias("repo_id"), F.replace("shape", F.lit("{}"), F.col("doc_id").cast("string")).alias("path")
    )


@query(
    "unsafe_name_filter",
    f"""WITH n AS (SELECT source AS repo_id, replace(shape, '{{}}', CAST(doc_id AS VARCHAR)) AS path FROM documents, (VALUES {_SHAPES_SQL}) t(shape))
SELECT repo_id, path FROM n WHERE NOT list_contains(string_split(path, '/'), '..') AND NOT starts_with(path, '/') AND NOT contains(path, ':')
 AND NOT list_has_any(string_split(path, '/'), [{", ".join(lit_sql(d) for d in inventory.IGNORED_DIRS)}])
 AND {oracle.DECLARED} NOT IN ({", ".join(lit_sql(e) for e in inventory.IGNORED_EXTS)})""",
)
def _(spark, sf):
    return inventory.filter_unsafe_names(_shaped_names(spark, sf))


@query(
    "archive_budget",
    """WITH m AS (SELECT l_suppkey AS archive, CAST(floor(l_extendedprice) AS BIGINT) AS size,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS INTEGER) AS ordinal FROM lineitem),
r AS (SELECT *, CAST(sum(size) OVER (PARTITION BY archive ORDER BY ordinal) AS BIGINT) AS running_size FROM m WHERE ordinal < 500)
SELECT archive, ordinal, size, running_size FROM r WHERE running_size <= 10000000""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    members = line.select(
        F.lit("r").alias("repo_id"),
        F.col("l_suppkey").alias("archive"),
        "l_extendedprice",
        (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")) - 1).alias("ordinal"),
    ).select("repo_id", "archive", "ordinal", F.floor("l_extendedprice").cast("long").alias("size"))
    return archives.archive_budget(members, max_bytes=10_000_000, max_members=500).select(
        "archive", "ordinal", "size", "running_size"
    )


@query(
    "read_and_decode",
    f"""SELECT repo_id, path, octet_length(encode(content)) AS size, sha256(content) AS sha256, length(content) AS n_chars FROM ({DOCS})""",
)
def _(spark, sf):
    docs = documents_as_files(spark, sf)
    raw = docs.select("repo_id", "path", "size", F.encode("content", "UTF-8").alias("raw"))
    return inventory.with_content(raw).select(
        "repo_id", "path", "size", "sha256", F.length("content").cast("long").alias("n_chars")
    )


_MIME_CASE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in inventory.MIME_TYPES.items()) + f" ELSE '{inventory.UNKNOWN_MIME}' END"


@query(
    "mime_and_flags",
    f"""{SEEDED} SELECT repo_id, path, {oracle.DECLARED} AS declared_ext, {_MIME_CASE} AS detected_mime,
 contains({_MIME_CASE}, 'text') AS is_text, ends_with(lower(path), '.svg') AS is_svg, {in_list('ext', inventory.SCRIPT_EXTS)} AS is_script,
 {in_list('ext', inventory.CONFIG_EXTS)} AS is_config FROM f""",
)
def _(spark, sf):
    return seeded_files(spark, sf).select(
        "repo_id", "path", "declared_ext", "detected_mime", "is_text", "is_svg", "is_script", "is_config"
    )


def _head_sql(n: int) -> str:
    return f"left(content, list_max(list_filter(range(0, {n + 1}), lambda i: octet_length(encode(left(content, i))) <= {n})))"


@query(
    "sniffed_types",
    f"""WITH f AS ({seeded_sql()}), h AS (SELECT *, {_head_sql(200)} AS h2, {_head_sql(500)} AS h5, {_MIME_CASE} AS mime FROM f)
SELECT repo_id, path, contains(h2, '<svg') OR contains(h2, '<SVG') OR contains(h5, {lit_sql(inventory.SVG_NAMESPACE)}) AS sniffed_svg,
 {" OR ".join(f"contains(lower(h2), {lit_sql(s)})" for s in inventory.SCRIPT_HEADS)} AS sniffed_script,
 starts_with(mime, 'text/') OR {in_list('mime', inventory.TEXT_MIMES)} AS sniffed_text FROM h""",
)
def _(spark, sf):
    files = seeded_files(spark, sf).withColumn("raw", F.encode("content", "UTF-8"))
    return inventory.with_sniffed_type(files).select("repo_id", "path", "sniffed_svg", "sniffed_script", "sniffed_text")


@query(
    "inventory_totals",
    f"{SEEDED} SELECT repo_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM f GROUP BY repo_id",
)
def _(spark, sf):
    return inventory.inventory_totals(seeded_files(spark, sf))


# ---- text primitives


@query(
    "lines",
    f"""{SEEDED}, s AS (SELECT repo_id, path, string_split(content, chr(10)) AS p FROM f),
t AS (SELECT repo_id, path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM s)
SELECT repo_id, path, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no, unnest(p) AS line FROM t""",
)
def _(spark, sf):
    return explode_lines(seeded_files(spark, sf))


@query(
    "find_all",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", "[A-Za-z]+ing|[0-9]+", False, "true")], "f")})
SELECT repo_id, path, CAST(start AS INTEGER) AS start, CAST(line_no AS INTEGER) AS line_no, matched FROM occ""",
)
def _(spark, sf):
    return find_all(seeded_files(spark, sf), "[A-Za-z]+ing|[0-9]+").select("repo_id", "path", "start", "line_no", "matched")


@query(
    "truncated_context",
    f"""{SEEDED}, l AS ({oracle.lines_sql('f')})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, {cut('line', 60)} AS short, {oracle._context('line', "'e'")} AS around
FROM l WHERE contains(line, 'e')""",
)
def _(spark, sf):
    lines = explode_lines(seeded_files(spark, sf)).where(F.contains("line", F.lit("e")))
    return lines.select(
        "repo_id", "path", "line_no", truncate(F.col("line"), 60).alias("short"), context(F.col("line"), F.lit("e")).alias("around")
    )


@query(
    "meaningful_text",
    f"""SELECT repo_id, path, length(content) >= 5 AND length(regexp_replace(content, '[^ -~]', '', 'g')) / length(content) >= 0.7
 AND NOT (length(content) > 50 AND regexp_full_match(content, '\\pL+')) AS meaningful FROM ({CORPUS})""",
)
def _(spark, sf):
    return corpus_as_files(spark, sf).select("repo_id", "path", is_meaningful(F.col("content")).alias("meaningful"))


@query(
    "line_entropy",
    f"""{SEEDED}, l AS ({oracle.lines_sql('f')}),
c AS (SELECT repo_id, path, line_no, ch, length(line) AS total, count(*) AS n FROM (SELECT *, unnest(string_split(line, '')) AS ch FROM l WHERE line <> '') GROUP BY ALL)
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, round(-sum(n / total * log2(n / total)), 4) + 0.0 AS entropy FROM c GROUP BY ALL""",
)
def _(spark, sf):
    lines = explode_lines(seeded_files(spark, sf)).where("line <> ''")
    return lines.select("repo_id", "path", "line_no", (F.round(shannon_entropy(F.col("line")), 4) + 0.0).alias("entropy"))


@query("file_names", f"{SEEDED} SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS name, ext FROM f")
def _(spark, sf):
    path = F.col("path")
    return seeded_files(spark, sf).select(
        "repo_id", "path", file_name(path).alias("name"), F.regexp_extract(F.lower(path), r"\.[^./]*$", 0).alias("ext")
    )


# ---- deobfuscation


def _sql_translate(text: str, chars: str, to: str = "") -> str:
    return f"translate({text}, {lit_sql(chars)}, {lit_sql(to)})"


@query(
    "unicode_cleanup",
    f"""{SEEDED} SELECT repo_id, path, md5({_sql_translate('content', unicode.ZERO_WIDTH)}) AS visible, md5({_sql_translate('content', unicode.BIDI)}) AS no_bidi,
 md5({_sql_translate('content', ''.join(unicode.HOMOGLYPHS), ''.join(unicode.HOMOGLYPHS.values()))}) AS latin,
 CAST(length(content) - length({_sql_translate('content', unicode.ZERO_WIDTH)}) AS INTEGER) AS invisible FROM f""",
)
def _(spark, sf):
    content = F.col("content")
    return seeded_files(spark, sf).select(
        "repo_id", "path",
        F.md5(unicode.strip_invisible(content)).alias("visible"),
        F.md5(unicode.strip_bidi(content)).alias("no_bidi"),
        F.md5(unicode.normalize_homoglyphs(content)).alias("latin"),
        unicode.count_invisible(content).alias("invisible"),
    )


_BIDI_VALUES = ", ".join(f"({lit_sql(c)}, 'Bidi override U+{ord(c):04X}')" for c in unicode.BIDI)


@query(
    "trojan_source_lines",
    f"""{SEEDED}, l AS ({oracle.lines_sql('f')})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, code_point FROM l, (VALUES {_BIDI_VALUES}) t(c, code_point) WHERE contains(line, c)""",
)
def _(spark, sf):
    return unicode.trojan_lines(seeded_files(spark, sf))


@query(
    "hidden_hex_strings",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", decode.HEX_ESCAPES, False, "true")], "f")})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, 'hex_escape' AS kind, decode(unhex(replace(matched, '\\x', ''))) AS decoded FROM occ""",
)
def _(spark, sf):
    return decode.hex_escapes(seeded_files(spark, sf))


_EVAL_RX = lit_sql(decode.EVAL_BASE64)


@query(
    "hidden_eval_strings",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", decode.EVAL_BASE64, False, "true")], "f")})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, 'eval_base64' AS kind, decode(from_base64(regexp_extract(matched, {_EVAL_RX}, 1))) AS decoded FROM occ""",
)
def _(spark, sf):
    return decode.eval_base64(seeded_files(spark, sf))


_UNICODE_CHARS = (
    "list_reduce(list_transform(string_split(substring(matched, 3), '\\u'), lambda h: chr(CAST(concat('0x', h) AS INTEGER))), lambda a, b: concat(a, b))"
)


@query(
    "hidden_unicode_strings",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", decode.UNICODE_ESCAPES, False, "true")], "f")})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, 'unicode_escape' AS kind, {_UNICODE_CHARS} AS decoded FROM occ""",
)
def _(spark, sf):
    return decode.unicode_escapes(seeded_files(spark, sf))


_CODES_RX = lit_sql(decode.FROM_CHAR_CODE)


@query(
    "hidden_char_codes",
    f"""{SEEDED}, occ AS ({oracle.occurrences_sql([("x", decode.FROM_CHAR_CODE, False, "true")], "f")})
SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, 'from_char_code' AS kind, list_reduce(list_transform(
 string_split(regexp_extract(matched, {_CODES_RX}, 1), ','), lambda x: chr(CAST(trim(x) AS INTEGER))), lambda a, b: concat(a, b)) AS decoded FROM occ""",
)
def _(spark, sf):
    return decode.char_codes(seeded_files(spark, sf))


@query(
    "script_urls",
    f"{SEEDED} SELECT repo_id, path, unnest(regexp_extract_all(content, {lit_sql(decode.SCRIPT_URL)})) AS url FROM f",
)
def _(spark, sf):
    return decode.script_urls(seeded_files(spark, sf))


# Every document's lines, wrapped in one to three layers by length of the line.
def _wrapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = explode_lines(documents_as_files(spark, sf))
    encoded = F.encode("line", "UTF-8")
    # Some versions of Spark break base64 into lines, which the decoders do not take for base64.
    packed = lambda raw: F.regexp_replace(F.base64(raw), "[\r\n]", "")
    once, hexed = packed(encoded), F.hex(encoded)
    kind = F.length("line") % 4
    return lines.where("line <> ''").select(
        "repo_id", "path", "line_no", "line",
        F.when(kind == 0, once).when(kind == 1, hexed).when(kind == 2, packed(F.encode(hexed, "UTF-8")))
        .otherwise(F.url_encode("line")).alias("wrapped"),
    )


def _layers_sql() -> str:
    """The decoders one after the other; bytes that are no text count as not decoded, which prose never meets."""

    def fine(text: str) -> str:
        printable = f"length(regexp_replace({text}, '[^\\x20-\\x7e]', '', 'g'))"
        return f"(coalesce(length({text}), 0) >= 5 AND {printable} / length({text}) >= 0.7 AND NOT (length({text}) > 50 AND regexp_full_match({text}, '\\pL+')))"

    url = "replace(replace(replace(url_encode(line), '%20', '+'), '%2A', '*'), '~', '%7E')"
    steps = [
        f"d AS ({DOCS})",
        "l AS (SELECT * FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM d) WHERE line <> '')",
        "w0 AS (SELECT repo_id, path, line_no, CASE length(line) % 4 WHEN 0 THEN to_base64(encode(line)) WHEN 1 THEN hex(encode(line)) "
        f"WHEN 2 THEN to_base64(encode(hex(encode(line)))) ELSE {url} END AS d, CAST(NULL AS VARCHAR) AS t FROM l)",
    ]
    for n in range(decode.MAX_LAYERS):
        steps.append(
            f"c{n} AS (SELECT *, CASE WHEN regexp_full_match(d, '[0-9a-fA-F]+') AND length(d) >= 4 AND length(d) % 2 = 0 THEN try(decode(unhex(d))) END AS h, "
            "CASE WHEN regexp_full_match(d, '[A-Za-z0-9+/]+={0,2}') AND length(d) > 10 AND length(d) % 4 = 0 THEN try(decode(from_base64(d))) END AS b, "
            f"CASE WHEN contains(d, '%') THEN try(url_decode(d)) END AS p FROM w{n})"
        )
        pick = f"CASE WHEN {fine('h')} THEN {{h}} WHEN {fine('b')} THEN {{b}} WHEN {fine('p')} AND p <> d THEN p"
        strip = f"trim({{}}, {oracle.SP})"
        steps.append(
            f"w{n + 1} AS (SELECT repo_id, path, line_no, {pick.format(h=strip.format('h'), b=strip.format('b'))} END AS d, {pick.format(h='h', b='b')} ELSE t END AS t FROM c{n})"
        )
    return f"WITH {', '.join(steps)} SELECT repo_id, path, CAST(line_no AS INTEGER) AS line_no, t AS decoded FROM w{decode.MAX_LAYERS}"


@query("layered_decode", _layers_sql())
def _(spark, sf):
    wrapped = _wrapped_lines(spark, sf).drop("line")
    return decode.layered_decode(wrapped, "wrapped").select("repo_id", "path", "line_no", "decoded")


@query("unescape_js")
def _(spark, sf):
    lines = explode_lines(seeded_files(spark, sf))
    return decode.unescape_js(lines, "line").where("unescaped is not null").select("repo_id", "path", "line_no", "unescaped")


# ---- WebAssembly and archives, built from the documents


# Import lists that planted modules carry.
WASM_IMPORTS = [
    [("env", "system"), ("env", "memory")],
    [("wasi_snapshot_preview1", "fd_write"), ("net", "connect")],
    [("js", "log")],
    [("any", "dlopen"), ("env", "fork"), ("sock", "recv"), ("js", "memory64"), ("js", "limit"), ("js", "thrown"), ("js", "refs"), ("sock", "listen")],
    [],
]
# What may follow the two names: function with a two-byte index, table, memory with a maximum, 64-bit memory, global, tag,
# table of typed references.
WASM_DESCRIPTORS = ["008001", "01700010", "02010180a003", "020481808080808001", "037f00", "04007f", "01637000ff7f"]


def _leb_hex(n: int) -> str:
    """An unsigned LEB128 number in hex."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return (bytes(out) + bytes([n])).hex()


def wasm_import_section(imports: list[tuple[str, str]]) -> str:
    """An import section in hex; descriptors take turns."""
    body = _leb_hex(len(imports))
    for i, names in enumerate(imports):
        for name in names:
            body += _leb_hex(len(name.encode())) + name.encode().hex()
        body += WASM_DESCRIPTORS[i % len(WASM_DESCRIPTORS)]
    return "02" + _leb_hex(len(body) // 2) + body


def _leb3(n: Column) -> Column:
    """A length as three LEB128 bytes, in hex."""
    def two(value: Column) -> Column:
        return F.lpad(F.hex(value.cast("long")), 2, "0")

    return F.concat(two(n % 128 + 128), two(F.floor(n / 128) % 128 + 128), two(F.floor(n / 16384) % 128))


def _wasm_modules(spark: SparkSession, sf: str) -> DataFrame:
    """A module per document: a custom section with the whole text, then an import section."""
    sections = [wasm_import_section(imports) for imports in WASM_IMPORTS]
    which = (F.col("doc_id") % len(WASM_IMPORTS)).cast("int")
    docs = read_texts(spark, sf, "documents", "doc_id", "source", "text")
    raw = F.concat(
        F.unhex(F.lit("0061736D0100000000")),
        F.unhex(_leb3(F.octet_length("text"))),
        F.encode("text", "UTF-8"),
        F.unhex(F.get(F.array(*[F.lit(s) for s in sections]), which)),
    )
    return docs.select(
        F.col("source").alias("repo_id"), F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".wasm")).alias("path"), raw.alias("raw")
    )


_WASM_CTE = (
    "i AS (SELECT source AS repo_id, concat('m/', doc_id, '.wasm') AS path, ordinal, module, name FROM documents JOIN (VALUES "
    + ", ".join(
        f"({k}, {n}, {lit_sql(m)}, {lit_sql(x)})" for k, imports in enumerate(WASM_IMPORTS) for n, (m, x) in enumerate(imports)
    )
    + f") t(k, ordinal, module, name) ON doc_id % {len(WASM_IMPORTS)} = k)"
)
_DANGER = "(" + in_list("name", wasm.DANGEROUS_ANYWHERE) + "".join(
    f" OR (module = {lit_sql(m)} AND {in_list('name', names)})" for m, names in wasm.DANGEROUS_BY_MODULE.items()
) + ")"
_NETWORK = in_list("name", wasm.NETWORK)


@query("wasm_imports", f"WITH {_WASM_CTE} SELECT repo_id, path, CAST(ordinal AS INTEGER) AS ordinal, module, name FROM i")
def _(spark, sf):
    return wasm.wasm_imports(_wasm_modules(spark, sf))


@query(
    "wasm_findings",
    f"""WITH {_WASM_CTE}
SELECT repo_id, path, 'A2' AS rule_id, 'critical' AS severity, concat(module, '.', name) AS raw_value FROM i WHERE {_DANGER}
UNION ALL SELECT repo_id, path, 'A3', 'high', concat(module, '.', name) FROM i WHERE {_NETWORK}
UNION ALL SELECT repo_id, path, 'A4', 'critical', NULL FROM i GROUP BY repo_id, path HAVING bool_or({_DANGER})
UNION ALL SELECT repo_id, path, 'A4', 'high', NULL FROM i GROUP BY repo_id, path HAVING bool_or({_NETWORK})""",
)
def _(spark, sf):
    return wasm.detect_wasm(_wasm_modules(spark, sf)).select("repo_id", "path", "rule_id", "severity", "raw_value")


def _document_archives(spark: SparkSession, sf: str) -> DataFrame:
    """A zip per document: the text, copies under names that must be skipped, and a nested zip with the text."""
    def pack(batches):
        import io
        import zipfile

        import pyarrow as pa

        def zipped(members):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for name, data in members:
                    z.writestr(name, data)
            return buffer.getvalue()

        def one(text):
            inner = zipped([("b.txt", text), ("dist/c.js", text), ("d.zip", "x")])
            return zipped([("a.md", text), ("../e.txt", text), ("node_modules/f.js", text), ("g.so", text), ("pack/inner.zip", inner)])

        # Few archives leave at a time: they are larger than the texts, and a worker holds no more of them.
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = pa.array([one(text.as_py()) for text in part["text"]], pa.binary())
                yield pa.RecordBatch.from_arrays([part["repo_id"], part["path"], raw], ["repo_id", "path", "raw"])

    docs = read_texts(spark, sf, "documents", "doc_id", "source", "text")
    named = docs.select(F.col("source").alias("repo_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), "text")
    return named.mapInArrow(pack, "repo_id string, path string, raw binary")


@query(
    "expand_archives",
    """SELECT source AS repo_id, concat(doc_id, '.zip') AS archive, CAST(d AS INTEGER) AS depth, p AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256
FROM documents, (VALUES (0, 'a.md'), (1, 'inner/b.txt')) t(d, p)""",
)
def _(spark, sf):
    return archives.expand_archives(_document_archives(spark, sf)).select(
        "repo_id", "archive", "depth", "path", "size", F.sha2("raw", 256).alias("sha256")
    )


_MEMBERS_SQL = """SELECT concat(source, '!', doc_id, '.zip') AS repo_id, p AS path, text AS content
 FROM documents, (VALUES ('a.md'), ('inner/b.txt')) t(p)"""


def _as_scan_files(source: str) -> str:
    """The name-based columns of a files relation, as the detectors' SQL expects them."""
    return (
        "SELECT *, octet_length(encode(content)) AS size, lower(regexp_extract(path, '[^/]*$')) AS name, "
        f"regexp_extract(lower(path), '\\.[^./]*$') AS ext FROM ({source})"
    )


@query("scan_archives", oracle.content_sql(behavior.RULES, _as_scan_files(_MEMBERS_SQL)))
def _(spark, sf):
    members = archives.expand_archives(_document_archives(spark, sf))
    files = inventory.prepare_files(archives.members_as_files(members))
    return families.detect_behavior(files).select(*FINDING_COLUMNS)


# ---- incremental


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old: all documents. New: toxic ones gone, low-quality ones edited, conversations added."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    old = docs.select(F.col("source").alias("repo_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = docs.join(labels, "doc_id", "left").where("toxic is null or toxic = 0").select(
        F.col("source").alias("repo_id"), path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256")
    )
    turns = conversations_as_files(spark, sf).select("repo_id", "path", "size", F.sha2("content", 256).alias("sha256"))
    return old, kept.unionByName(turns)


_SNAPSHOTS = """old AS (SELECT source AS repo_id, concat('docs/', doc_id) AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents),
new AS (SELECT source AS repo_id, concat('docs/', doc_id) AS path, octet_length(encode(t)) AS size, sha256(t) AS sha256 FROM (
   SELECT d.doc_id, source, CASE WHEN quality = 0 THEN concat(text, '!') ELSE text END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
   WHERE toxic IS NULL OR toxic = 0)
 UNION ALL SELECT role, concat('conv/', conv_id, '/', turn, '.md'), octet_length(encode(text)), sha256(text) FROM conversations)"""
_DIFF = """diff AS (SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path,
 CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
 FROM old o FULL JOIN new n ON o.repo_id = n.repo_id AND o.path = n.path WHERE o.sha256 IS DISTINCT FROM n.sha256)"""


@query("diff_snapshots", f"WITH {_SNAPSHOTS}, {_DIFF} SELECT * FROM diff")
def _(spark, sf):
    return incremental.diff_snapshots(*_snapshots(spark, sf))


@query(
    "only_changed",
    f"WITH {_SNAPSHOTS}, {_DIFF} SELECT repo_id, path, size FROM new SEMI JOIN (SELECT * FROM diff WHERE change <> 'deleted') d USING (repo_id, path)",
)
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return incremental.only_changed(new, incremental.changed_paths(old, new)).select("repo_id", "path", "size")


@query(
    "split_cached",
    f"""WITH {_SNAPSHOTS} SELECT n.repo_id, count(*) FILTER (WHERE o.path IS NULL) AS to_scan, count(o.path) AS to_reuse
FROM new n LEFT JOIN old o ON n.repo_id = o.repo_id AND n.path = o.path AND n.size = o.size AND n.sha256 = o.sha256 GROUP BY n.repo_id""",
)
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    version = rules_version(select_rules())
    ledger = incremental.ledger_rows(old, version, F.lit("2024-01-01").cast("timestamp"))
    todo, reuse = incremental.split_cached(new, ledger, version)
    marked = todo.select("repo_id", F.lit(1).alias("t")).unionByName(reuse.select("repo_id", F.lit(0).alias("t")))
    return marked.groupBy("repo_id").agg(F.sum("t").alias("to_scan"), F.sum(1 - F.col("t")).alias("to_reuse"))


@query(
    "incremental_scan",
    f"SELECT repo_id, path, rule_id, severity, line_no, length(path) % 2 = 0 AS reused FROM ({oracle.content_sql(secrets.RULES)})",
)
def _(spark, sf):
    """A first scan of one half, then a second of everything that takes the first half's findings from the ledger's run."""
    out = run_folder(spark, "increment")
    files = seeded_files(spark, sf).withColumn("sha256", F.sha2("content", 256))
    version = rules_version(secrets.RULES)
    first = files.where(F.length("path") % 2 == 0)
    families.detect_secrets(first).write.parquet(f"{out}/findings")
    incremental.ledger_rows(first, version, F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{out}/ledger")
    todo, kept = incremental.split_cached(files, spark.read.parquet(f"{out}/ledger"), version)
    fresh = families.detect_secrets(todo).withColumn("reused", F.lit(False))
    old = incremental.reused_findings(kept, spark.read.parquet(f"{out}/findings")).withColumn("reused", F.lit(True))
    return fresh.unionByName(old).select("repo_id", "path", "rule_id", "severity", "line_no", "reused")


@query(
    "prune_ledger",
    """SELECT repo_id, path, scanned_at FROM (SELECT event_type AS repo_id, concat('e/', event_id) AS path, ts AS scanned_at,
 row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, concat('e/', event_id)) AS rn FROM events) WHERE rn <= 1000""",
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    ledger = events.select(
        F.col("event_type").alias("repo_id"), F.concat(F.lit("e/"), F.col("event_id").cast("string")).alias("path"),
        F.sha2("props", 256).alias("sha256"), F.col("ts").alias("scanned_at"),
    )
    return incremental.prune_ledger(ledger, incremental.LEDGER_LIMIT).select("repo_id", "path", "scanned_at")


@query(
    "analyzer_errors",
    f"{SEEDED} SELECT repo_id, count(*) AS analyzer_errors FROM (SELECT repo_id, content, unnest(['postinstall', 'preinstall', 'install', 'n']) AS h FROM f "
    "WHERE name = 'package.json') WHERE json_type(content, '$.scripts.' || h) NOT IN ('VARCHAR') AND h <> 'n' GROUP BY repo_id",
)
def _(spark, sf):
    from palisade.plans.scan import analyzer_errors

    return analyzer_errors(dependencies.manifest_errors(seeded_files(spark, sf)))


# ---- feeds and joins

_ADVISORY_BODY = """to_json({'vulns': [{'id': 'ADV-' || p_partkey, 'aliases': CASE WHEN p_size % 2 = 0 THEN ['CVE-' || p_size, 'GHSA-' || p_partkey] ELSE [] END,
 'summary': CASE WHEN p_size % 3 > 0 THEN p_name END, 'details': p_type, 'references': [{'url': CASE WHEN p_size % 5 = 0 THEN 'https://x/CVE-1' ELSE 'https://x/a' END}]}]})"""


def _advisory_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup answers as JSON text, one per part."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    key = F.col("p_partkey").cast("string")
    vuln = F.struct(
        F.concat(F.lit("ADV-"), key).alias("id"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("CVE-"), F.col("p_size").cast("string")), F.concat(F.lit("GHSA-"), key)))
        .otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("summary"),
        F.col("p_type").alias("details"),
        F.array(F.struct(F.when(F.col("p_size") % 5 == 0, "https://x/CVE-1").otherwise("https://x/a").alias("url"))).alias("references"),
    )
    return part.select(
        F.col("p_brand").alias("ecosystem"), F.concat(F.lit("part-"), key).alias("name"),
        F.to_json(F.struct(F.array(vuln).alias("vulns"))).alias("body"),
    )


_ADVISORIES = """a AS (SELECT p_brand AS ecosystem, concat('part-', p_partkey) AS name, concat('ADV-', p_partkey) AS id,
 CASE WHEN p_size % 2 = 0 THEN concat('CVE-', p_size, ', GHSA-', p_partkey) ELSE concat('ADV-', p_partkey) END AS advisory,
 CASE WHEN p_size % 3 > 0 THEN p_name ELSE p_type END AS summary, CASE WHEN p_size % 5 = 0 THEN 'high' ELSE 'unknown' END AS severity FROM part)"""


@query("feed_advisories", f"WITH {_ADVISORIES} SELECT ecosystem, name, id FROM a")
def _(spark, sf):
    return feeds.flatten_advisories(_advisory_answers(spark, sf)).select("ecosystem", "name", "id")


@query(
    "known_vulnerable",
    f"""WITH {_ADVISORIES} SELECT concat('order-', l_orderkey) AS repo_id, CAST(l_linenumber AS VARCHAR) AS path, ecosystem, name,
 CAST(l_linenumber AS VARCHAR) AS version, advisory, summary, severity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN a ON a.name = concat('part-', l_partkey)""",
)
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    pinned = F.col("l_linenumber").cast("string")
    deps = line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"), pinned.alias("path"),
        F.col("p_brand").alias("ecosystem"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), pinned.alias("version"),
    )
    return threat_joins.known_vulnerable(deps, feeds.flatten_advisories(_advisory_answers(spark, sf)))


@query(
    "known_malware",
    """SELECT source AS repo_id, concat('docs/', lang, '/', d.doc_id, '.txt') AS path, sha256(text) AS sha256, 'family-' || lang AS malware FROM documents d
SEMI JOIN (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) m ON sha256(d.text) = m.h""",
)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    digest = F.sha2("text", 256)
    # One remembered answer per distinct hash of a labelled document; harmless ones are remembered misses.
    answers = docs.join(labels, "doc_id").groupBy(digest.alias("sha256")).agg(
        F.max("toxic").alias("toxic"), F.min("lang").alias("lang")
    ).select(
        "sha256",
        F.to_json(
            F.when(
                F.col("toxic") == 1,
                F.struct(
                    F.lit("ok").alias("query_status"),
                    F.array(F.struct(F.col("sha256").alias("sha256_hash"), F.concat(F.lit("family-"), "lang").alias("malware"))).alias("data"),
                ),
            ).otherwise(
                F.struct(
                    F.lit("hash_not_found").alias("query_status"),
                    F.lit(None).cast("array<struct<sha256_hash:string,malware:string>>").alias("data"),
                )
            )
        ).alias("body"),
    )
    files = documents_as_files(spark, sf).withColumn("sha256", F.sha2("content", 256))
    return threat_joins.known_malware(files, feeds.flatten_malware(answers))


def _c2_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A host list as text lines: one per supplier, with comments and blanks in between."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    host = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    line = F.explode(F.array(F.concat(F.lit("# "), "s_name"), F.lit("  "), F.concat(F.lit(" "), host, F.lit("\t"), F.col("s_nationkey").cast("string"))))
    return supplier.select(line.alias("value"))


@query("feed_c2_lines", "SELECT concat('s', s_suppkey, '.example.com') AS host FROM supplier")
def _(spark, sf):
    return feeds.parse_c2_lines(_c2_feed(spark, sf))


@query(
    "known_c2",
    "SELECT concat('order-', l_orderkey) AS repo_id, concat('https://s', l_suppkey, '.example.com/', l_linenumber) AS url FROM lineitem "
    "SEMI JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000) ON l_suppkey = s_suppkey",
)
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    url = F.concat(
        F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.com/"), F.col("l_linenumber").cast("string")
    )
    seen = line.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"), F.lit("x").alias("path"), url.alias("url"), F.lit(1).alias("line_no"))
    bad = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal < 5000")
    feed = feeds.parse_c2_lines(bad.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com 1")).alias("value")))
    return threat_joins.known_c2(urls.with_url_parts(seen), feed).select("repo_id", "url")


@query(
    "feed_fresh",
    "SELECT event_id, ts AS fetched_at FROM events WHERE epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(ts) < 21600",
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").alias("fetched_at"))
    return feeds.fresh(events, feeds.TTL_SECONDS["malware"], F.lit("2024-01-10 00:00:00"))


@query(
    "feed_upsert",
    "SELECT user_id, max(ts) AS fetched_at, arg_max(value, ts) AS value FROM events GROUP BY user_id",
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").alias("fetched_at"), "event_type", "value")
    old = events.where("event_type <> 'click'").drop("event_type")
    new = events.where("event_type = 'click'").drop("event_type")
    return feeds.upsert(old, new, ["user_id"])


# ---- scores, policy, history, reports. Findings come from two cheap families over the seeded corpus.


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    files = seeded_files(spark, sf)
    return scoring.union_findings(families.detect_secrets(files), families.detect_workflows(files), urls.detect_urls(files))


def _stored_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Reports read findings several times, so they are written once, as a scan job does."""
    out = run_folder(spark, "findings")
    _findings(spark, sf).write.parquet(out)
    return spark.read.parquet(out)


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories: every source, and every conversation role, the latter without findings."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("repo_id"))
    roles = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("role").alias("repo_id"))
    return docs.unionByName(roles)


_FIND = "(" + ") UNION ALL (".join(
    [
        oracle.content_sql(secrets.RULES), oracle.line_rules_sql(workflows.LINE_RULES), oracle.content_sql(workflows.RULES),
        oracle.workflow_file_sql(), oracle.reusable_sql(), oracle.urls_sql(),
    ]
) + ")"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in scoring.LEVELS)
_RISK = f"""fi AS ({_FIND}), rp AS (SELECT source AS repo_id FROM documents UNION SELECT role FROM conversations),
cn AS (SELECT repo_id, {_COUNTS}, count(*) AS total FROM fi GROUP BY repo_id),
rk AS (SELECT rp.repo_id, CAST(least(10.0, 3 * coalesce(critical, 0) + 1.5 * coalesce(high, 0) + 0.5 * coalesce(medium, 0)) AS DOUBLE) AS score,
 CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'info' END AS max_severity,
 coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total
 FROM rp LEFT JOIN cn USING (repo_id))"""


@query("risk_score", f"WITH {_RISK} SELECT * FROM rk")
def _(spark, sf):
    return scoring.risk_score(_findings(spark, sf), _repos(spark, sf))


@query("severity_counts", f"WITH fi AS ({_FIND}) SELECT repo_id, category, {_COUNTS}, count(*) AS total FROM fi GROUP BY ALL")
def _(spark, sf):
    return scoring.severity_counts(_findings(spark, sf), "repo_id", "category")


_OVERRIDES = {"lifecycle_hook": "low", "unpinned_action": "medium"}


@query(
    "severity_overrides",
    f"WITH fi AS ({_FIND}) SELECT category, CASE category WHEN 'lifecycle_hook' THEN 'low' WHEN 'unpinned_action' THEN 'medium' ELSE severity END AS severity, "
    "count(*) AS n FROM fi GROUP BY ALL",
)
def _(spark, sf):
    return scoring.with_severity_overrides(_findings(spark, sf), _OVERRIDES).groupBy("category", "severity").agg(F.count("*").alias("n"))


_SEV_SORT = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(("critical", "high", "medium", "low", "info", "error"))) + " ELSE 99 END"


@query(
    "ordered_findings",
    f"WITH fi AS ({_FIND}) SELECT {_SEV_SORT} AS sev_sort, repo_id, path, coalesce(line_no, 0) AS line_no, title FROM fi",
)
def _(spark, sf):
    from palisade.schema import severity_sort

    return scoring.ordered_findings(_findings(spark, sf)).select(
        severity_sort(F.col("severity")).alias("sev_sort"), "repo_id", "path", F.coalesce("line_no", F.lit(0)).alias("line_no"), "title"
    )


@query(
    "shown_findings",
    f"WITH fi AS ({_FIND}) SELECT repo_id, path, severity, title FROM fi WHERE severity IN ('critical', 'high', 'low')",
)
def _(spark, sf):
    return scoring.shown_findings(_findings(spark, sf)).select("repo_id", "path", "severity", "title")


@query("findings_by_file", f"WITH fi AS ({_FIND}) SELECT repo_id, path, count(*) AS n FROM fi GROUP BY ALL")
def _(spark, sf):
    return scoring.findings_by_file(_findings(spark, sf))


@query(
    "search_findings",
    f"WITH fi AS ({_FIND}) SELECT repo_id, path, title, description FROM fi WHERE severity = 'critical' AND "
    "(contains(lower(path), 'key') OR contains(lower(title), 'key') OR contains(lower(description), 'key'))",
)
def _(spark, sf):
    return scoring.search_findings(_findings(spark, sf), "critical", "KEY").select("repo_id", "path", "title", "description")


_BLOCKED = "category IN ('credential_theft', 'ci_remote_exec', 'c2_callback') AND NOT starts_with(path, 'd1')"
_REACHED = "severity IN ('high', 'critical')"


POLICY = policy.Policy("high", ["credential_theft", "ci_remote_exec", "c2_callback"], ["d1"])


@query(
    "policy_violations",
    f"WITH fi AS ({_FIND}) SELECT repo_id, path, 'critical' AS severity, 'policy_violation' AS category, "
    f"concat('Finding category ''', category, ''' is blocked by policy') AS description, line_no FROM fi WHERE {_BLOCKED} AND {_REACHED}",
)
def _(spark, sf):
    return policy.policy_violations(_findings(spark, sf), POLICY).select(
        "repo_id", "path", "severity", "category", "description", "line_no"
    )


@query("policy_blocked_flag", f"WITH fi AS ({_FIND}) SELECT repo_id, path, title, {_BLOCKED} AS is_blocked FROM fi")
def _(spark, sf):
    return policy.with_blocked_flag(_findings(spark, sf), POLICY).select("repo_id", "path", "title", "is_blocked")


_GATE = f"""bl AS (SELECT repo_id, bool_or({_BLOCKED} AND {_REACHED}) AS b FROM fi GROUP BY repo_id),
gt AS (SELECT rk.*, coalesce(b, false) AS blocked, score >= 7.0 OR coalesce(b, false) AS failed FROM rk LEFT JOIN bl USING (repo_id))"""


@query("gate_decision", f"WITH {_RISK}, {_GATE} SELECT * FROM gt")
def _(spark, sf):
    return scoring.decide(_findings(spark, sf), _repos(spark, sf), POLICY)


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    """History: one scan per order, scored from its lines (A returned, high discount, any)."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    severity = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_discount") > 0.05, "high").otherwise("medium")
    counts = scoring.score(scoring.severity_counts(line.select(F.col("l_orderkey").alias("k"), severity.alias("severity")), "k"))
    return orders.join(counts, orders.o_orderkey == counts.k).select(
        F.col("o_orderkey").cast("string").alias("scan_id"), F.col("o_custkey").cast("string").alias("repo_id"),
        F.col("o_orderdate").alias("scan_time"), "score", "max_severity", *scoring.LEVELS, "total",
    )


def _scan_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags: priority and status of the order, the status twice, as a sloppy caller would."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("scan_id", F.col("o_orderkey").cast("string"))
    return history.tag_rows(orders, F.array("o_orderpriority", "o_orderstatus", "o_orderstatus"))


_SCANS = f"""ls AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_discount > 0.05 THEN 'high' ELSE 'medium' END AS severity FROM lineitem),
lc AS (SELECT k, {_COUNTS}, count(*) AS total FROM ls GROUP BY k),
sc AS (SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, CAST(o_custkey AS VARCHAR) AS repo_id, o_orderdate AS scan_time,
 CAST(least(10.0, 3 * critical + 1.5 * high + 0.5 * medium) AS DOUBLE) AS score,
 CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS max_severity,
 critical, high, medium, low, total FROM orders JOIN lc ON o_orderkey = k)"""
_SCAN_KEEP = "scan_id, repo_id, scan_time, score, max_severity"


@query("history_list", f"WITH {_SCANS} SELECT {_SCAN_KEEP} FROM sc ORDER BY scan_time DESC, scan_id LIMIT 50 OFFSET 10")
def _(spark, sf):
    return history.list_scans(_scans(spark, sf), 50, 10).select(*_SCAN_KEEP.split(", "))


@query(
    "history_by_tag",
    f"WITH {_SCANS} SELECT {_SCAN_KEEP} FROM sc SEMI JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS scan_id FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = 'F') USING (scan_id) "
    "WHERE max_severity = 'high' ORDER BY scan_time DESC, scan_id LIMIT 50",
)
def _(spark, sf):
    return history.list_scans(_scans(spark, sf), 50, 0, "F", _scan_tags(spark, sf), "high").select(*_SCAN_KEEP.split(", "))


@query("history_by_id", f"WITH {_SCANS} SELECT {_SCAN_KEEP} FROM sc WHERE scan_id = '7'")
def _(spark, sf):
    return history.scan_by_id(_scans(spark, sf), "7").select(*_SCAN_KEEP.split(", "))


@query(
    "history_delete",
    f"WITH {_SCANS}, dd AS (SELECT scan_id FROM sc WHERE score < 5) SELECT s.max_severity, count(DISTINCT s.scan_id) AS scans, count(*) AS tags FROM sc s "
    "JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, unnest([o_orderpriority, o_orderstatus, o_orderstatus]) AS tag FROM orders) t USING (scan_id) "
    "WHERE scan_id NOT IN (SELECT scan_id FROM dd) GROUP BY ALL",
)
def _(spark, sf):
    scans = _scans(spark, sf)
    kept, tags = history.delete_scans(scans, _scan_tags(spark, sf), scans.where("score < 5"))
    return kept.join(tags, "scan_id").groupBy("max_severity").agg(
        F.count_distinct("scan_id").alias("scans"), F.count("*").alias("tags")
    )


@query("history_totals", f"WITH {_SCANS} SELECT count(*) AS total_scans, round(avg(score), 1) AS avg_risk_score FROM sc")
def _(spark, sf):
    return history.scan_totals(_scans(spark, sf))


@query("history_worst", f"WITH {_SCANS} SELECT repo_id, score, scan_time FROM sc ORDER BY score DESC, scan_time DESC, scan_id LIMIT 1")
def _(spark, sf):
    return history.worst_scan(_scans(spark, sf)).select("repo_id", "score", "scan_time")


@query("history_recent", f"WITH {_SCANS} SELECT repo_id, score, scan_time FROM sc ORDER BY scan_time DESC, scan_id LIMIT 5")
def _(spark, sf):
    return history.recent_scans(_scans(spark, sf)).select("repo_id", "score", "scan_time")


@query("history_append", f"WITH {_SCANS} SELECT scan_id, repo_id, scan_time, score, total FROM sc")
def _(spark, sf):
    out = run_folder(spark, "scans")
    scans = _scans(spark, sf)
    # Two runs: scans with a critical finding, then the others.
    for part in (scans.where("critical > 0"), scans.where("critical = 0")):
        history.append_scans(part.withColumn("scan_date", F.trunc("scan_time", "year")), out)
    return spark.read.parquet(out).select("scan_id", "repo_id", "scan_time", "score", "total")


@query(
    "redacted_findings",
    f"WITH fi AS ({_FIND}) SELECT repo_id, path, title, line_no, {cut('snippet', 120)} AS snippet, {cut('description', 120)} AS description, "
    "CASE WHEN raw_value IS NOT NULL THEN '<redacted>' END AS raw_value FROM fi",
)
def _(spark, sf):
    return history.redact(_findings(spark, sf)).select("repo_id", "path", "title", "line_no", "snippet", "description", "raw_value")


_ROUND_TRIP = (
    f"WITH fi AS ({_FIND}) SELECT repo_id, path, severity, confidence, category, title, description, line_no, {cut('snippet', 300)} AS snippet, "
    f"{cut('raw_value', 200)} AS raw_value FROM fi"
)


@query("json_round_trip", _ROUND_TRIP)
def _(spark, sf):
    back = reports.parse_findings_json(reports.findings_json(_findings(spark, sf)))
    return back.select("repo_id", "path", "severity", "confidence", "category", "title", "description", "line_no", "snippet", "raw_value")


_JSON_FIELDS = [
    ("file", "path"), ("severity", "severity"), ("confidence", "confidence"), ("category", "category"), ("title", "title"),
    ("line", "line_no"), ("snippet", cut("snippet", 300)), ("raw", cut("raw_value", 200)),
]


@query(
    "json_findings",
    f"WITH fi AS ({_FIND}) SELECT repo_id, " + ", ".join(f"CAST({e} AS VARCHAR) AS {n}" for n, e in _JSON_FIELDS) + " FROM fi",
)
def _(spark, sf):
    body = reports.findings_json(_findings(spark, sf))
    return body.select("repo_id", *[F.get_json_object("body", f"$.{n}").alias(n) for n, _ in _JSON_FIELDS])


@query("sarif_log")
def _(spark, sf):
    found = _stored_findings(spark, sf)
    scans = scoring.risk_score(found, _repos(spark, sf)).withColumn("files_count", F.lit(0))
    return reports.sarif_rows(found, scans)


_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' WHEN 'info' THEN 'none' ELSE 'error' END"


@query(
    "sarif_results",
    f"WITH fi AS ({_FIND}) SELECT repo_id, concat('PAL-', upper(category)) AS rule, {_LEVEL} AS level, path AS uri, "
    "CASE WHEN line_no > 0 THEN CAST(line_no AS VARCHAR) END AS line, concat(title, ': ', description) AS message FROM fi",
)
def _(spark, sf):
    found = _stored_findings(spark, sf)
    body = F.col("body")
    return reports.sarif_results(found, reports.sarif_rules(found)).select(
        "repo_id",
        F.get_json_object(body, "$.ruleId").alias("rule"),
        F.get_json_object(body, "$.level").alias("level"),
        F.get_json_object(body, "$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        F.get_json_object(body, "$.locations[0].physicalLocation.region.startLine").alias("line"),
        F.get_json_object(body, "$.message.text").alias("message"),
    )


@query(
    "summary_lines",
    f"""WITH {_RISK} SELECT repo_id, concat('RISK SCORE: ', printf('%.1f', score), ' / 10.0  (', max_severity, ')') AS score_line,
 concat(critical, ' critical, ', high, ' high, ', medium, ' medium, ', low, ' low') AS count_line, concat('Total findings: ', total) AS total_line FROM rk""",
)
def _(spark, sf):
    return reports.summary_lines(scoring.risk_score(_findings(spark, sf), _repos(spark, sf)))


@query("json_report")
def _(spark, sf):
    found = _stored_findings(spark, sf)
    scans = scoring.risk_score(found, _repos(spark, sf)).withColumns(
        {
            "scan_time": F.lit("2024-01-01 00:00:00").cast("timestamp"), "files_count": F.lit(0), "blocked": F.lit(False),
            "analyzer_errors": F.lit(0), "skipped_cache": F.lit(0),
        }
    )
    return reports.json_documents(scans, found)


# ---- whole scans


@query("full_scan")
def _(spark, sf):
    """All families over all three tables, the documents with their seeds; written once as prepared files."""
    out = run_folder(spark, "files")
    files = seeded_files(spark, sf).unionByName(pages_as_files(spark, sf)).unionByName(conversations_as_files(spark, sf))
    files.write.parquet(out)
    found = scan(spark.read.parquet(out), focus_dir=run_folder(spark, "focus"))
    return found.select(*FINDING_COLUMNS, "analyzer", "attack_path", "remediation")


@query("quick_scan_tables")
def _(spark, sf):
    out = run_folder(spark, "files")
    corpus_as_files(spark, sf).write.parquet(out)
    return scan(spark.read.parquet(out), quick=True, focus_dir=run_folder(spark, "focus")).select(*FINDING_COLUMNS, "analyzer")


@query("stream_scan", oracle.content_sql(behavior.RULES, _as_scan_files(DOCS)))
def _(spark, sf):
    """The documents table read as a stream, scanned batch by batch, and read back."""
    from palisade.sources.tables import text_as_file

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    # As a pattern the path may be a file or a folder of files; a stream's plain path has to be a folder.
    stream = spark.readStream.schema(schema).option("basePath", sf).parquet(f"{sf}/documents.parque[t]")
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = text_as_file(stream, F.col("source"), path, F.col("text"))
    out = run_folder(spark, "stream")
    stream_scan(files, f"{out}/findings", f"{out}/checkpoint", families.detect_behavior).awaitTermination()
    return streamed_findings(spark, f"{out}/findings").select(*FINDING_COLUMNS)


_FLAGSHIP = f"""WITH f AS (SELECT *, octet_length(encode(content)) AS size, lower(regexp_extract(path, '[^/]*$')) AS name,
 regexp_extract(lower(path), '\\.[^./]*$') AS ext FROM ({CORPUS})),
occ AS ({oracle.occurrences_sql([(r.rule_id, r.pattern, r.ignore_case, oracle.gate_sql(r)) for r in [*behavior.RULES, *secrets.RULES]], 'f')}),
fi AS (SELECT repo_id, CASE rule_id {" ".join(f"WHEN '{r.rule_id}' THEN '{r.severity}'" for r in [*behavior.RULES, *secrets.RULES])} END AS severity FROM occ),
cn AS (SELECT repo_id, {_COUNTS}, count(*) AS total FROM fi GROUP BY repo_id)
SELECT r.repo_id, CAST(least(10.0, 3 * coalesce(critical, 0) + 1.5 * coalesce(high, 0) + 0.5 * coalesce(medium, 0)) AS DOUBLE) AS score,
 CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'info' END AS max_severity,
 coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(total, 0) AS total,
 false AS blocked, least(10.0, 3 * coalesce(critical, 0) + 1.5 * coalesce(high, 0) + 0.5 * coalesce(medium, 0)) >= 7.0 AS failed
FROM (SELECT DISTINCT repo_id FROM f) r LEFT JOIN cn ON r.repo_id = cn.repo_id"""


@query("risk_gate_tables", _FLAGSHIP)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """All text tables, behaviour and secret rules in one pass, risk per repository, gate."""
    files = corpus_as_files(spark, sf)
    return scoring.decide_counts(severity_counts_of(files, [*behavior.RULES, *secrets.RULES]))


# Queries in modules of their own register themselves.
from palisade.plans import queries_more, queries_runs  # noqa: E402, F401
