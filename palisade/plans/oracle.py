"""DuckDB SQL for the registered queries.

The SQL is written against the driver tables alone and finds positions by another route than the Spark code: it takes each
match, measures the text in front of it, and cuts windows out of the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from palisade.functions.unicode import BIDI, HOMOGLYPHS, ZERO_WIDTH
from palisade.operators import dependencies, entropy, families, mime, scripts, svg, unicode_tricks, urls
from palisade.plans.seeded import _sql_text as q
from palisade.plans.seeded import seeded_sql
from palisade.rules import builds, docker, network, secrets, workflows
from palisade.rules.base import LineRule, Rule
from palisade.sources import files as inventory

SP = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NULL_TEXT = "CAST(NULL AS VARCHAR)"

TEXT_EXTS = [e for e, m in inventory.MIME_TYPES.items() if "text" in m]


def in_list(column: str, values: Sequence[str]) -> str:
    return f"{column} IN (" + ", ".join(q(v) for v in values) + ")"


TEXT_GATE = in_list("ext", TEXT_EXTS)


WORKFLOW_GATE = (
    "(name IN ('action.yml','action.yaml','.gitlab-ci.yml','.gitlab-ci.yaml','azure-pipelines.yml','jenkinsfile')"
    " OR contains(lower(path), '.github/workflows/') OR lower(path) = '.circleci/config.yml'"
    " OR ends_with(lower(path), '/.circleci/config.yml'))"
)
SVG_GATE = "(ends_with(lower(path), '.svg'))"


def gate_sql(rule: Rule | LineRule) -> str:
    if rule.rule_id.startswith("G"):
        return "name = 'build.rs'"
    if rule.rule_id in ("H12", "H13", "H14"):
        return "name = 'pyproject.toml'"
    return {
        "behavioral": TEXT_GATE,
        "yara": TEXT_GATE,
        "secrets": f"({in_list('ext', TEXT_EXTS)} AND NOT {in_list('name', secrets.LOCK_FILES)})",
        "dockerfile_analyzer": in_list("name", docker.FILE_NAMES),
        "python_analyzer": "name = 'setup.py'",
        "workflow": WORKFLOW_GATE,
    }[rule.analyzer]


def cut(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) > {limit} THEN concat(left({text}, {limit}), '...') ELSE {text} END"


def occurrences_sql(rows: Sequence[tuple[str, str, bool, str]], source: str, text: str = "content", extra: str = "") -> str:
    """rows: (rule id, RE2 pattern, ignore case, gate). Gives every match with start, line_no, matched, txt."""
    parts = []
    for rule_id, pattern, ignore_case, gate in rows:
        rx = q(("(?i)" if ignore_case else "") + pattern)
        parts.append(
            f"SELECT repo_id, path{extra}, {text} AS txt, {q(rule_id)} AS rule_id, string_split_regex({text}, {rx}) AS p, "
            f"regexp_extract_all({text}, {rx}) AS m FROM {source} WHERE {gate} AND regexp_matches({text}, {rx})"
        )
    return (
        f"SELECT *, 1 + length(left(txt, start)) - length(replace(left(txt, start), chr(10), '')) AS line_no FROM ("
        f"SELECT repo_id, path{extra}, txt, rule_id, m[i] AS matched, "
        "CAST(list_sum(list_transform(p[1:i], lambda s: length(s))) + "
        "coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS start "
        f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(parts)})))"
    )


def window(before: int, after: int, cap: int) -> str:
    text = (
        f"substring(txt, greatest(start - {before}, 0) + 1, "
        f"start + length(matched) + {after} - greatest(start - {before}, 0))"
    )
    return cut(text, cap)


def finding(rule_id: str, severity: str, confidence: str, category: str, title: str, description: str, line_no: str = "NULL",
            snippet: str = "NULL", decoded: str = "NULL", raw_value: str = "NULL") -> str:
    """The select list of a finding; arguments are SQL expressions."""
    return (
        f"repo_id, path, {rule_id} AS rule_id, {severity} AS severity, {confidence} AS confidence, {category} AS category, "
        f"{title} AS title, {description} AS description, CAST({line_no} AS INTEGER) AS line_no, "
        f"CAST({snippet} AS VARCHAR) AS snippet, CAST({decoded} AS VARCHAR) AS decoded, CAST({raw_value} AS VARCHAR) AS raw_value"
    )


# RE2 knows no look-ahead: the pattern without it, and the condition in SQL.
NO_LOOKAHEAD = {
    "H13": (r"build-backend\s*=\s*[\"']", "substring(txt, start + length(matched) + 1, 10) <> 'setuptools'"),
}


def content_sql(rules: Sequence[Rule], source: str | None = None) -> str:
    rows = [
        (r.rule_id, NO_LOOKAHEAD.get(r.rule_id, (r.pattern, ""))[0], r.ignore_case, gate_sql(r)) for r in rules
    ]
    picks = []
    for r in rules:
        description = q(r.description)
        if r.cut:
            description = f"concat({q(r.description)}, {cut('matched', r.cut)}, {q(r.tail)})"
        where = f"rule_id = {q(r.rule_id)}"
        if r.rule_id in NO_LOOKAHEAD:
            where += f" AND {NO_LOOKAHEAD[r.rule_id][1]}"
        picks.append(
            "SELECT "
            + finding(q(r.rule_id), q(r.severity), q(r.confidence), q(r.category), q(r.title), description, "line_no",
                      window(*r.window) if r.window else "NULL")
            + f" FROM occ WHERE {where}"
        )
    return f"WITH f AS ({source or seeded_sql()}), occ AS ({occurrences_sql(rows, 'f')}) " + " UNION ALL ".join(picks)


def lines_sql(source: str, gate: str = "true") -> str:
    pieces = "string_split(content, chr(10))"
    return (
        f"SELECT repo_id, path, name, ext, size, line, line_no, trim(line, {SP}) AS stripped FROM ("
        f"SELECT *, unnest({pieces}) AS line, generate_subscripts({pieces}, 1) AS line_no FROM {source} WHERE {gate})"
    )


def line_rules_sql(rules: Sequence[LineRule]) -> str:
    gate = gate_sql(rules[0])
    picks = []
    for r in rules:
        target = "stripped" if r.stripped else "line"
        where = f"regexp_matches({target}, {q(('(?i)' if r.ignore_case else '') + r.pattern)}) AND stripped <> ''"
        if r.skip_comments:
            where += " AND NOT starts_with(stripped, '#')"
        description = f"concat(replace({q(r.description)}, '{{line}}', CAST(line_no AS VARCHAR)), {cut('stripped', r.cut)})"
        snippet = cut("stripped", r.snippet_cut) if r.snippet_cut else "stripped"
        picks.append(
            "SELECT " + finding(q(r.rule_id), q(r.severity), q(r.confidence), q(r.category), q(r.title), description, "line_no", snippet)
            + f" FROM l WHERE {where}"
        )
    return f"WITH f AS ({seeded_sql()}), l AS ({lines_sql('f', gate)}) " + " UNION ALL ".join(picks)


def dockerfile_absence_sql() -> str:
    picks = []
    for rule_id, directive, severity, confidence, title, description in docker.EXPECTED:
        picks.append(
            "SELECT " + finding(q(rule_id), q(severity), q(confidence), "'info'", q(title), q(description))
            + f" FROM f WHERE {in_list('name', docker.FILE_NAMES)} AND NOT EXISTS (SELECT 1 FROM l WHERE l.path = f.path "
            f"AND l.repo_id = f.repo_id AND starts_with(upper(l.stripped), '{directive} '))"
        )
    gate = in_list("name", docker.FILE_NAMES)
    return f"WITH f AS ({seeded_sql()}), l AS ({lines_sql('f', gate)}) " + " UNION ALL ".join(picks)


def workflow_file_sql() -> str:
    picks = []
    for rule_id, pats, severity, confidence, title, description in families.WORKFLOW_FILE_RULES:
        conditions = " AND ".join(f"regexp_matches(content, {q(('(?i)' if i else '') + p)})" for p, i in pats)
        picks.append(
            "SELECT " + finding(q(rule_id), q(severity), q(confidence), "'info'", q(title), q(description))
            + f" FROM f WHERE {WORKFLOW_GATE} AND {conditions}"
        )
    return f"WITH f AS ({seeded_sql()}) " + " UNION ALL ".join(picks)


def reusable_sql() -> str:
    rx = q("(?i)" + workflows.REUSABLE)
    return f"""
WITH f AS ({seeded_sql()}),
occ AS ({occurrences_sql([("W19", workflows.REUSABLE, True, WORKFLOW_GATE)], "f")}),
c AS (SELECT *, regexp_extract(matched, {rx}, 1) AS ref, regexp_extract(matched, {rx}, 2) AS version FROM occ)
SELECT {finding("'W19'", "'medium'", "'medium'", "'unpinned_action'", "concat('External reusable workflow: ', ref, '@', version)",
                "concat('Reusable workflow from ''', ref, ''' at ''', version, ''' runs foreign steps in this pipeline.')", "line_no",
                raw_value="concat(ref, '@', version)")}
FROM c WHERE contains(ref, '/') AND contains(ref, '.github/workflows/') AND split_part(ref, '/', 1) <> 'actions'
  AND NOT starts_with(split_part(ref, '/', 1), '.')"""


def cargo_manifest_sql() -> str:
    git = q("(?i)" + builds.CARGO_GIT)
    gate = "name = 'cargo.toml'"
    return f"""
WITH f AS ({seeded_sql()}),
occ AS ({occurrences_sql([("G1", builds.CARGO_GIT, True, gate), ("G3", builds.CARGO_PROC_MACRO, False, gate)], "f")}),
g AS (SELECT *, regexp_extract(matched, {git}, 1) AS url FROM occ)
SELECT {finding("'G1'", "'medium'", "'low'", "'suspicious_dependency'", f"concat('Cargo dependency from git: ', {cut('url', 80)})",
                "concat('Cargo.toml references git repository ''', url, ''' is taken from a moving source tree.')", "line_no", raw_value="url")}
FROM g WHERE rule_id = 'G1'
UNION ALL SELECT {finding("'G3'", "'info'", "'low'", "'info'", "'Cargo.toml defines a proc-macro crate'",
                          "'Compiling the crate already runs the code of its macros.'", "line_no")}
FROM g WHERE rule_id = 'G3'
UNION ALL SELECT {finding("'G2'", "'info'", "'high'", "'lifecycle_hook'", "'Cargo.toml has build script (build.rs)'",
                          "'Building the crate runs build.rs with the rights of the builder.'")}
FROM f WHERE {gate} AND regexp_matches(content, {q(builds.CARGO_BUILD)})"""


# ---- SVG

def _quoted(pattern_head: str, pattern_body: str, pattern_any: str = None) -> str:
    return f"{pattern_head}(?:\"{pattern_body}\"|'{pattern_body}')"


HANDLER_RE2 = "(?:" + "|".join(svg.EVENTS) + r")\s*=\s*(?:\"(.*?)\"|'(.*?)')"
JS_LINK_RE2 = r"href\s*=\s*(?:\"\s*javascript:([^\"']+)\"|'\s*javascript:([^\"']+)')"
EXTERNAL_RE2 = r"(?:href|xlink:href)\s*=\s*(?:\"(https?://[^\"']+)\"|'(https?://[^\"']+)')"
CALL_RE2 = r"(?:btoa|atob)\s*\(\s*(?:\"([A-Za-z0-9+/=]{20,})\"|'([A-Za-z0-9+/=]{20,})')\s*\)"


def both_groups(text: str, pattern: str, ignore_case: bool = True) -> str:
    rx = q(("(?i)" if ignore_case else "") + pattern)
    return f"concat(regexp_extract({text}, {rx}, 1), regexp_extract({text}, {rx}, 2))"


def obfuscated(text: str) -> str:
    score = " + ".join(f"CAST(regexp_matches({text}, {q(p)}) AS INTEGER)" for p in svg.OBFUSCATION)
    return f"(length({text}) >= {svg.MIN_OBFUSCATED} AND ({score}) >= {svg.MIN_INDICATORS})"


def svg_scripts_sql() -> str:
    rx = q("(?i)" + svg.SCRIPT)
    calls = ", ".join(q(c) for c in svg.EXEC_CALLS)
    apis = ", ".join(q(a) for a in svg.NODE_APIS)
    critical = in_list("c", svg.CRITICAL_CALLS)
    shown = cut("body", 300)
    return f"""
WITH f AS ({seeded_sql()}),
occ AS ({occurrences_sql([("V2", svg.SCRIPT, True, SVG_GATE)], "f")}),
b AS (SELECT * FROM (SELECT repo_id, path, line_no, trim(regexp_extract(matched, {rx}, 1), {SP}) AS body FROM occ) WHERE body <> '')
SELECT {finding("'V2'", "'high'", "'high'", "'obfuscated_script'", "'SVG <script> contains obfuscated JavaScript'",
                "'Escapes or encodings hide from a reader what the script does.'", "line_no", shown)} FROM b WHERE {obfuscated('body')}
UNION ALL SELECT {finding("'V3'", f"CASE WHEN {critical} THEN 'critical' ELSE 'high' END", "'high'", "'suspicious_js_api'",
                          "concat('SVG script uses ''', c, ''' — can execute arbitrary code')",
                          "concat('''', c, ''' evaluates strings as code or decodes payloads.')", "line_no", shown)}
FROM b, (SELECT unnest([{calls}]) AS c) WHERE contains(lower(body), lower(c))
UNION ALL SELECT {finding("'V4'", "'critical'", "'medium'", "'suspicious_node_api'", "concat('SVG script uses Node.js API ''', a, '''')",
                          "'A server runtime is expected, so the script is meant to run at build time.'", "line_no", shown)}
FROM b, (SELECT unnest([{apis}]) AS a) WHERE contains(lower(body), lower(a))
UNION ALL SELECT {finding("'V5'", "'high'", "'medium'", "'runtime_network_call'", "'SVG script phones home to external URL'",
                          "concat('Script contacts ', u, ', which may be a control server or serve a payload.')", "line_no", raw_value="u")}
FROM (SELECT *, unnest(regexp_extract_all(body, {q(svg.SCRIPT_URL)}, 1)) AS u FROM b)
WHERE NOT {in_list("split_part(u, '/', 1)", svg.CDN_HOSTS)}"""


def svg_attributes_sql() -> str:
    rows = [
        ("V6", HANDLER_RE2, True, SVG_GATE), ("V8", svg.DATA_URI, True, SVG_GATE), ("V9", svg.FOREIGN, True, SVG_GATE),
        ("V10", JS_LINK_RE2, True, SVG_GATE), ("V12", EXTERNAL_RE2, True, SVG_GATE),
        ("V13", svg.CSS_EXPRESSION, True, SVG_GATE),
    ]
    run = f"regexp_extract(v, {q(svg.LONG_BASE64)}, 1)"
    literal = both_groups(f"regexp_extract(v, {q(CALL_RE2)})", CALL_RE2, False)
    encoded = f"CASE WHEN {literal} <> '' THEN {literal} ELSE {run} END"

    def any_of(text: str, markers: list[str]) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), {q(m)})" for m in markers) + ")"

    return f"""
WITH f AS ({seeded_sql()}),
occ AS ({occurrences_sql(rows, "f")}),
g AS (SELECT *, CASE rule_id WHEN 'V6' THEN {both_groups('matched', HANDLER_RE2)}
   WHEN 'V8' THEN regexp_extract(matched, {q('(?i)' + svg.DATA_URI)}, 1)
   WHEN 'V9' THEN regexp_extract(matched, {q('(?i)' + svg.FOREIGN)}, 1)
   WHEN 'V10' THEN {both_groups('matched', JS_LINK_RE2)} WHEN 'V12' THEN {both_groups('matched', EXTERNAL_RE2)} END AS v FROM occ),
e AS (SELECT *, CASE WHEN rule_id IN ('V6', 'V8') THEN {encoded} END AS enc FROM g),
d AS (SELECT *, CASE WHEN enc <> '' THEN decode(from_base64(enc)) END AS dec FROM e)
SELECT {finding("'V6'", "'high'", "'high'", "'svg_event_handler'", "concat('Inline ''', split_part(matched, '=', 1), ''' handler executes JS')",
                f"concat('Handler: ', {cut('v', 200)})", "line_no", "v", "dec")} FROM d WHERE rule_id = 'V6'
UNION ALL SELECT {finding("'V7'", "'critical'", "'high'", "'encoded_payload'", "'Base64-encoded eval in SVG event handler'",
                          "'The handler decodes to an eval() call.'", "line_no", decoded="dec")}
FROM d WHERE rule_id = 'V6' AND contains(lower(dec), 'eval')
UNION ALL SELECT {finding("'V8'", "'critical'", "'high'", "'svg_data_uri'", "'Data URI contains executable JS'",
                          f"concat('Decodes to: ', {cut('dec', 200)})", "line_no", decoded="dec")}
FROM d WHERE rule_id = 'V8' AND {any_of('dec', svg.DATA_URI_MARKERS)}
UNION ALL SELECT {finding("'V9'", "'high'", "'medium'", "'svg_foreign_object'", "'SVG <foreignObject> sneaks in executable HTML/JS'",
                          "'Embedded HTML with active content inside the picture.'", "line_no")}
FROM d WHERE rule_id = 'V9' AND {any_of('v', svg.FOREIGN_MARKERS)}
UNION ALL SELECT {finding("'V10'", "'high'", "'high'", "'svg_event_handler'", "'javascript: URI in SVG link'",
                          f"concat('Link executes: ', {cut('v', 200)})", "line_no", "v")} FROM d WHERE rule_id = 'V10'
UNION ALL SELECT {finding("'V12'", "'low'", "'low'", "'c2_callback'", "'SVG links to external URL'",
                          "concat('External resource: ', v)", "line_no", raw_value="v")} FROM d WHERE rule_id = 'V12'
UNION ALL SELECT {finding("'V13'", "'high'", "'medium'", "'svg_event_handler'", "'CSS expression or javascript: in style context'",
                          "'Style expressions run code in some renderers.'", "line_no")} FROM d WHERE rule_id = 'V13'"""


def svg_lines_sql() -> str:
    rx = q("(?i)" + svg.SCRIPT)
    return f"""
WITH f AS ({seeded_sql()}),
l AS ({lines_sql('f', SVG_GATE)}),
b AS (SELECT repo_id, path, list_transform(regexp_extract_all(content, {rx}, 1), lambda s: trim(s, {SP})) AS bodies FROM f WHERE {SVG_GATE})
SELECT {finding("'V11'", "'high'", "'medium'", "'obfuscation_encoding'", "'Obfuscated string outside <script> tags'",
                f"concat('Line contains obfuscation indicators: ', {cut('stripped', 200)})", "line_no", "stripped")}
FROM l JOIN b USING (repo_id, path)
WHERE length(stripped) >= {svg.MIN_LINE} AND {obfuscated('stripped')} AND NOT list_contains(bodies, stripped)"""


def svg_xxe_sql() -> str:
    return f"""
WITH f AS ({seeded_sql()})
SELECT {finding("'V1'", "'critical'", "'high'", "'svg_xxe'", "'SVG contains XML External Entity (XXE) declaration'",
                "'An external entity can read local files or reach internal services when parsed.'")}
FROM f WHERE {SVG_GATE} AND regexp_matches(content, {q('(?i)' + svg.DOCTYPE)}) AND regexp_matches(content, {q('(?i)' + svg.ENTITY)})"""


# ---- Unicode

def _context(line: str, target: str) -> str:
    at = f"(strpos({line}, {target}) - 1)"
    begin = f"greatest({at} - 40, 0)"
    return cut(f"trim(substring({line}, {begin} + 1, {at} + 40 - {begin}), {SP})", 150)


def _quoted_char(text: str) -> str:
    shown = text
    for char, name in unicode_tricks.INVISIBLE:
        code = name[2:6].lower()
        shown = f"replace({shown}, {q(char)}, {q(('\\x' + code[2:]) if code.startswith('00') else '\\u' + code)})"
    return f"concat('''', {shown}, '''')"


def _unicode_lines() -> str:
    return f"WITH f AS ({seeded_sql()}), l AS ({lines_sql('f', TEXT_GATE)})"


def invisible_sql() -> str:
    table = ", ".join(f"({q(c)}, {q(n)})" for c, n in unicode_tricks.INVISIBLE)
    return f"""{_unicode_lines()},
h AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, c ORDER BY line_no) AS rn FROM l, (VALUES {table}) t(c, label) WHERE contains(line, c))
SELECT {finding("'U1'", "'medium'", "'high'", "'zero_width_char'", "concat('Zero-width/invisible Unicode character: ', label)",
                "'Invisible characters change what code does without showing in an editor.'", "line_no", _context("line", "c"),
                raw_value=_quoted_char("c"))} FROM h WHERE rn = 1"""


def bidi_sql() -> str:
    table = ", ".join(f"({q(c)})" for c in unicode_tricks.BIDI_OVERRIDES)
    return f"""{_unicode_lines()},
h AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, c ORDER BY line_no) AS rn FROM l, (VALUES {table}) t(c) WHERE contains(line, c))
SELECT {finding("'U2'", "'high'", "'high'", "'bidi_override'", "'Bidirectional text override character detected (Trojan Source)'",
                "'Override characters make code read differently from how it runs (CVE-2021-42574).'", "line_no", _context("line", "c"),
                raw_value=_quoted_char("c"))} FROM h WHERE rn = 1"""


def homoglyph_sql() -> str:
    keywords = ", ".join(f"({q(k)})" for k in unicode_tricks.KEYWORDS)
    pairs = ", ".join(f"({q(c)}, {q(a)})" for c, a in unicode_tricks.LOOK_ALIKES)
    return f"""{_unicode_lines()},
t AS (SELECT k, replace(k, lat, cyr) AS d FROM (VALUES {keywords}) a(k), (VALUES {pairs}) b(cyr, lat) WHERE replace(k, lat, cyr) <> k)
SELECT {finding("'U3'", "'high'", "'high'", "'homoglyph'", "concat('Homoglyph attack: ''', k, ''' disguised with Cyrillic characters')",
                "concat('''', d, ''' looks like ''', k, ''' but is another identifier.')", "line_no", _context("line", "d"))}
FROM l, t WHERE contains(line, d)"""


def file_names_sql() -> str:
    table = ", ".join(f"({q(c)}, {q(n)})" for c, n in unicode_tricks.INVISIBLE)
    bidi = ", ".join(f"({q(c)})" for c in unicode_tricks.BIDI_OVERRIDES)
    base = "regexp_extract(path, '[^/]*$')"
    description = f"concat('File ', {_quoted_char(base)}, ' is shown under a name it does not have.')"
    return f"""WITH f AS ({seeded_sql()})
SELECT {finding("'U4'", "'high'", "'high'", "'bidi_override'", "concat('Filename contains invisible Unicode character: ', label)",
                description, raw_value=_quoted_char(base))}
FROM f, (VALUES {table}) t(c, label) WHERE {TEXT_GATE} AND contains({base}, c)
UNION ALL SELECT {finding("'U5'", "'critical'", "'high'", "'bidi_override'", "'Filename contains bidi override character (Trojan Source in filename)'",
                          description, raw_value=_quoted_char(base))}
FROM f, (VALUES {bidi}) t(c) WHERE {TEXT_GATE} AND contains({base}, c)"""


# ---- scripts and dependencies

SCRIPT_GATE = (
    f"({in_list('name', scripts.FILE_NAMES)} OR " + " OR ".join(f"ends_with(path, {q(s)})" for s in scripts.SUFFIXES) + ")"
)


def _manifest_scripts() -> str:
    return (
        "SELECT repo_id, path, k AS script, content ->> ('$.scripts.\"' || k || '\"') AS text FROM ("
        "SELECT repo_id, path, content, unnest(json_keys(content, '$.scripts')) AS k FROM f WHERE name = 'package.json') "
        "WHERE json_type(content, '$.scripts.\"' || k || '\"') = 'VARCHAR'"
    )


def commands_sql(ignore_case: bool = True) -> str:
    rows = [(i, p, ignore_case, "true") for i, p, *_ in scripts.PATTERNS]
    picks = []
    for i, _, severity, title, _n in scripts.PATTERNS:
        text = (
            "substring(text, greatest(start - 30, 0) + 1, start + length(matched) + 30 - greatest(start - 30, 0))"
        )
        picks.append(
            "SELECT " + finding(q(i), q(severity), "'medium'", "'suspicious_command'", q(title),
                                f"concat('Matched pattern: ', {cut('matched', 120)})", "line_no", cut(text, 200))
            + f" FROM occ WHERE rule_id = {q(i)}"
        )
    return (
        f"WITH f AS ({seeded_sql()}), s AS ({_manifest_scripts()}), "
        f"t AS (SELECT repo_id, path, text, lower(text) AS low FROM s UNION ALL SELECT repo_id, path, content, lower(content) FROM f "
        f"WHERE {SCRIPT_GATE} AND name <> 'package.json'), "
        f"occ AS ({occurrences_sql(rows, 't', 'low', ', text')}) " + " UNION ALL ".join(picks)
    )


def lifecycle_sql() -> str:
    return f"""WITH f AS ({seeded_sql()}), s AS ({_manifest_scripts()})
SELECT {finding("'C21'", "'info'", "'high'", "'lifecycle_hook'", "concat('Package has ''', script, ''' lifecycle script')",
                f"concat('Installing the package runs: ', {cut('text', 200)})", snippet="text")}
FROM s WHERE {in_list('script', scripts.LIFECYCLE_HOOKS)}"""


def _deps_cte() -> str:
    parts = [
        f"SELECT repo_id, path, {i} AS ord, {q(s)} AS section, k AS name, content ->> ('$.{s}.\"' || k || '\"') AS value, "
        f"json_type(content, '$.{s}.\"' || k || '\"') AS kind FROM (SELECT repo_id, path, content, "
        f"unnest(json_keys(content, '$.{s}')) AS k FROM f WHERE name = 'package.json')"
        for i, s in enumerate(dependencies.NPM_SECTIONS)
    ]
    return (
        f"raw AS ({' UNION ALL '.join(parts)}), "
        "deps AS (SELECT repo_id, path, section, name, CASE WHEN kind = 'VARCHAR' THEN value ELSE '*' END AS version, kind FROM ("
        "SELECT *, row_number() OVER (PARTITION BY repo_id, path, name ORDER BY ord DESC) AS rn FROM raw) WHERE rn = 1)"
    )


def npm_deps_sql() -> str:
    return f"WITH f AS ({seeded_sql()}), {_deps_cte()} SELECT repo_id, path, section, name, version FROM deps"


def url_dependencies_sql() -> str:
    starts = " OR ".join(f"starts_with(version, {q(p)})" for p in scripts.URL_PREFIXES)
    return f"""WITH f AS ({seeded_sql()}), {_deps_cte()}
SELECT {finding("'C23'", "'critical'", "'high'", "'url_dependency'", f"concat('Dependency ''', name, ''' resolved from URL: ', {cut('version', 100)})",
                "'A version that is an address bypasses the registry and can change at any time.'", raw_value="version")}
FROM deps WHERE kind = 'VARCHAR' AND ({starts})"""


def dependency_rules_sql() -> str:
    d = dependencies
    popular = ", ".join(q(p) for p in d.POPULAR)

    def values(items):
        return ", ".join(f"({q(i)})" for i in items)

    base = "regexp_extract(name, '[^/]*$')"
    versions = " UNION ALL ".join(
        "SELECT " + finding("'D7'", q(sev), "'high'", "'suspicious_dependency'", f"concat(name, {q(': ' + text)})",
                            f"concat('Dependency ''', name, ''' version ''', version, {q(chr(39) + ' triggered: ' + text)})", raw_value="version")
        + f" FROM deps WHERE regexp_matches(version, {q(pattern)})"
        for pattern, sev, text in d.VERSION_PATTERNS
    )
    return f"""WITH f AS ({seeded_sql()}), {_deps_cte()},
b AS (SELECT *, {base} AS base, lower({base}) AS low, concat(name, '@', version) AS pinned FROM deps)
SELECT {finding("'D2'", "'info'", "'low'", "'suspicious_dependency'", "concat('Scoped package ''', name, ''' — verify it resolves to the right registry')",
                "'An unconfigured private scope falls back to the public registry.'", raw_value="name")}
FROM b WHERE starts_with(name, '@') AND contains(name, '/')
UNION ALL SELECT {finding("'D4'", "'high'", "'medium'", "'suspicious_dependency'",
                          "concat('Suspicious prefix on ''', name, ''': ''', x, ''' added to ''', substring(base, length(x) + 1), '''')",
                          "concat('''', x, ''' before a popular name is a common squatting pattern.')", raw_value="pinned")}
FROM b, (VALUES {values(d.PREFIXES)}) t(x) WHERE starts_with(low, x) AND substring(low, length(x) + 1) IN ({popular})
UNION ALL SELECT {finding("'D5'", "'high'", "'medium'", "'suspicious_dependency'",
                          "concat('Suspicious suffix on ''', name, ''': adds ''', x, ''' to ''', left(base, length(base) - length(x)), '''')",
                          "concat('''', x, ''' after a popular name is a common squatting pattern.')", raw_value="pinned")}
FROM b, (VALUES {values(d.SUFFIXES)}) t(x) WHERE ends_with(low, x) AND left(low, length(low) - length(x)) IN ({popular})
UNION ALL SELECT {finding("'D6'", "'high'", "'medium'", "'suspicious_dependency'",
                          "concat(name, ': Package name contains suspicious pattern ''', x, '''')",
                          "concat('Dependency ''', name, '''@', version, ': name matches suspicious pattern ''', x, '''.')", raw_value="pinned")}
FROM b, (VALUES {values(d.NAME_FRAGMENTS)}) t(x) WHERE contains(lower(name), replace(x, '*', ''))
UNION ALL {versions}"""


def hooks_sql() -> str:
    return f"""WITH f AS ({seeded_sql()}), s AS ({_manifest_scripts()})
SELECT {finding("'D8'", "'high'", "'high'", "'postinstall_chain'", "concat('Package has ''', script, ''' script with suspicious operations')",
                f"concat('The install step runs: ', {cut('text', 200)})", snippet="text")}
FROM s WHERE {in_list('script', dependencies.HOOKS)} AND regexp_matches(text, {q('(?i)' + dependencies.HOOK_PATTERN)})"""


def npm_lock_sql() -> str:
    return f"""WITH f AS ({seeded_sql()}),
p AS (SELECT repo_id, path, k AS package, content ->> ('$.packages."' || k || '".resolved') AS resolved,
      content ->> ('$.packages."' || k || '".integrity') AS integrity
      FROM (SELECT repo_id, path, content, unnest(json_keys(content, '$.packages')) AS k FROM f WHERE name = 'package-lock.json') WHERE k <> ''),
n AS (SELECT *, list_extract(string_split(package, 'node_modules/'), -1) AS name FROM p)
SELECT {finding("'D10'", "'critical'", "'high'", "'url_dependency'", f"concat('Lockfile resolved URL outside registry: ', {cut('resolved', 100)})",
                "concat('Package ''', name, ''' resolves to ''', resolved, ''', which is another place than the public registry.')", raw_value="resolved")}
FROM n WHERE resolved <> '' AND NOT contains(resolved, {q(dependencies.NPM_REGISTRY)})
UNION ALL SELECT {finding("'D11'", "'high'", "'high'", "'suspicious_dependency'", f"concat('Suspicious integrity hash: ', {cut('integrity', 60)})",
                          "concat('Package ''', package, ''' carries a checksum of unknown kind: ', integrity)")}
FROM n WHERE integrity <> '' AND NOT starts_with(integrity, 'sha')"""


def pipfile_lock_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT repo_id, path, k AS name, content ->> ('$.{s}.\"' || k || '\".version') AS version FROM ("
        f"SELECT repo_id, path, content, unnest(json_keys(content, '$.{s}')) AS k FROM f WHERE name = 'pipfile.lock')"
        for s in ("default", "develop")
    )
    return f"""WITH f AS ({seeded_sql()}), v AS ({parts})
SELECT {finding("'D17'", "'high'", "'medium'", "'url_dependency'", f"concat('Pipfile.lock URL dependency: ', name, ' -> ', {cut('version', 100)})",
                "concat('Package ''', name, ''' takes its version from an address: ', version)", raw_value="concat(name, '==', version)")}
FROM v WHERE contains(version, '://')"""


def dependency_lines_sql() -> str:
    d = dependencies
    names = [row[1] for row in d.LOCK_LINES] + ["requirements.txt", "pipfile", "gemfile", "go.mod", "go.sum"]
    picks = []
    for rule_id, name, marker, hosts, severity, confidence, title, description in d.LOCK_LINES:
        url = f"trim(trim(list_extract(string_split(stripped, {q(marker)}), -1), {SP}), concat('\"', ''''))"
        outside = " AND ".join(f"NOT contains({url}, {q(h)})" for h in hosts)
        picks.append(
            "SELECT " + finding(q(rule_id), q(severity), q(confidence), "'url_dependency'", f"concat({q(title)}, {cut(url, 100)})",
                                f"concat({q(description)}, {url})", raw_value=url)
            + f" FROM l WHERE name = {q(name)} AND starts_with(stripped, {q(marker)}) AND contains(stripped, 'https://') AND {outside}"
        )
    pip = (
        "name IN ('requirements.txt', 'pipfile') AND stripped <> '' AND NOT starts_with(stripped, '#') AND NOT starts_with(stripped, '//') "
        "AND (NOT starts_with(stripped, '-') OR starts_with(stripped, '-e '))"
    )
    fields = "list_filter(regexp_split_to_array(stripped, '\\s+'), lambda x: x <> '')"
    for rule_id, severity, confidence, category, title, description, where in [
        ("D13", "high", "medium", "url_dependency", f"concat('Python dependency from URL: ', {cut('stripped', 100)})",
         "'A dependency by address bypasses the index.'", f"{pip} AND contains(stripped, '@') AND contains(stripped, '://')"),
        ("D14", "medium", "medium", "suspicious_dependency", "'Editable pip install — can execute arbitrary setup.py'",
         f"concat('Editable install: ', {cut('stripped', 100)})",
         f"{pip} AND (starts_with(stripped, '-e ') OR contains(stripped, ' --editable'))"),
        ("D15", "medium", "low", "suspicious_dependency", f"concat('Ruby gem from non-standard source: ', {cut('stripped', 100)})",
         "'Gems from elsewhere than the registry can bring untrusted code.'",
         "name = 'gemfile' AND (contains(line, 'git:') OR contains(line, 'github:') OR contains(line, 'path:'))"),
        ("D19", "medium", "low", "suspicious_dependency", f"concat('Go module replace directive: ', {cut('stripped', 120)})",
         "'A replaced module may come from a fork or a local path.'",
         "name = 'go.mod' AND starts_with(stripped, 'replace ') AND contains(stripped, '=>')"),
        ("D20", "info", "low", "suspicious_dependency", f"concat('Go module comment references URL: ', {cut('stripped', 120)})",
         "'A comment on an indirect dependency holds an address.'",
         "name = 'go.mod' AND starts_with(stripped, '// ') AND contains(lower(stripped), 'indirect') AND contains(stripped, '://')"),
        ("D21", "low", "low", "suspicious_dependency", f"concat('Non-standard go.sum hash: ', {cut(fields + '[3]', 40)})",
         f"concat('Module ''', {fields}[1], '@', {fields}[2], ''' uses non-standard hash: ', {fields}[3])",
         f"name = 'go.sum' AND len({fields}) >= 3 AND NOT starts_with({fields}[3], 'h1:')"),
    ]:
        picks.append(
            "SELECT " + finding(q(rule_id), q(severity), q(confidence), q(category), title, description, "line_no", "stripped")
            + f" FROM l WHERE {where}"
        )
    return f"WITH f AS ({seeded_sql()}), l AS ({lines_sql('f', in_list('name', names))}) " + " UNION ALL ".join(picks)


# ---- URLs

URLS_CTE = (
    "occ AS (" + occurrences_sql([("N1", urls.URL_PATTERN, True, TEXT_GATE)], "f") + "), "
    f"u AS (SELECT repo_id, path, rtrim(matched, {q(urls.TRAILING_PUNCTUATION)}) AS url, line_no FROM occ)"
)
HOST = "lower(regexp_extract({0}, '^[A-Za-z]+://(?:[^/?#]*@)?([^/?#:@]*)', 1))"


def _under(host: str, domains: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{host} = {q(d)} OR ends_with({host}, {q('.' + d)})" for d in domains) + ")"


def extract_urls_sql() -> str:
    return f"WITH f AS ({seeded_sql()}), {URLS_CTE} SELECT repo_id, path, url, CAST(line_no AS INTEGER) AS line_no FROM u"


def url_parts_sql() -> str:
    host = HOST.format("url")
    return f"""WITH f AS ({seeded_sql()}), {URLS_CTE},
d AS (SELECT repo_id, path, url, CAST(min(line_no) AS INTEGER) AS line_no FROM u GROUP BY ALL)
SELECT *, {host} AS host, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)@', 1) AS userinfo,
  CASE WHEN contains({host}, '.') THEN regexp_extract({host}, '[^.]*$') ELSE '' END AS tld FROM d"""


def urls_sql() -> str:
    def one(condition: str, text: str) -> str:
        return f"CASE WHEN {condition} THEN [{text}] ELSE [] END"

    number = (
        r"CASE WHEN regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') "
        "THEN list_reduce(list_transform(string_split(host, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END"
    )
    private = " OR ".join(f"num BETWEEN {urls._number(a)} AND {urls._number(b)}" for a, b in urls.PRIVATE_RANGES)
    loopback = f"num BETWEEN {urls._number('127.0.0.0')} AND {urls._number('127.255.255.255')}"
    keywords = "[" + ", ".join(q(k) for k in urls.SUSPICIOUS_KEYWORDS) + "]"
    c2 = "[" + ", ".join(q(d) for d in urls.C2_DOMAINS) + "]"
    return f"""WITH p AS ({url_parts_sql()}),
n AS (SELECT *, {number} AS num, list_filter({c2}, lambda d: host = d OR ends_with(host, '.' || d)) AS c2,
      userinfo NOT IN ('', ':') AS creds FROM p WHERE NOT {_under('host', network.SAFE_HOSTS)}),
s AS (SELECT *, list_concat(
   {one(loopback, "concat('Loopback address (', host, ')')")},
   {one(private, "concat('Private IP address (', host, ') — possible SSRF or internal scan')")},
   {one(in_list('tld', urls.SUSPICIOUS_TLDS), "concat('Suspicious TLD: .', tld)")},
   list_transform(list_filter({keywords}, lambda k: contains(lower(url), k)), lambda k: concat('URL contains ''', k, '''')),
   list_transform(c2, lambda d: concat('Hostname matches known C2/paste pattern: ', d)),
   {one(f"length(url) > {urls.LONG_URL}", "concat('Unusually long URL (', length(url), ' chars)')")},
   {one('creds', "'URL contains embedded credentials'")}) AS signals FROM n)
SELECT {finding("'N11'", "CASE WHEN len(c2) > 0 OR creds THEN 'critical' ELSE 'high' END", "'medium'", "'c2_callback'",
                "'Suspicious external URL detected'", "array_to_string(signals, '; ')", "line_no", raw_value="url")}
FROM s WHERE len(signals) > 0"""


def network_calls_sql() -> str:
    rows = [(i, p, True, TEXT_GATE) for i, p, *_ in network.NETWORK_CALLS]
    labels = "CASE rule_id " + " ".join(f"WHEN {q(i)} THEN {q(label)}" for i, _, label, _n in network.NETWORK_CALLS) + " END"
    host = HOST.format("url")
    return f"""WITH f AS ({seeded_sql()}), occ AS ({occurrences_sql(rows, 'f')}),
c AS (SELECT *, {labels} AS label, CASE WHEN regexp_matches(matched, {q(network.CALL_URL)}) THEN regexp_extract(matched, {q(network.CALL_URL)}) ELSE 'UNKNOWN' END AS url FROM occ)
SELECT {finding("rule_id", "'high'", "'medium'", "'runtime_network_call'", "concat('Runtime network call via ', label)",
                "concat('Code makes network request to: ', url)", "line_no", raw_value="url")}
FROM c WHERE NOT {_under(host, network.SAFE_HOSTS)}"""


# ---- MIME, entropy

def mime_sql(source: str) -> str:
    """``source`` gives repo_id, path, content, declared."""
    head = "left(content, list_max(list_filter(range(0, 101), lambda i: octet_length(encode(left(content, i))) <= 100)))"
    image = in_list("declared", inventory.IMAGE_EXTS)

    def pick(rule_id, where, severity, confidence, category, what, description, raw="NULL"):
        return (
            "SELECT " + finding(q(rule_id), q(severity), q(confidence), q(category),
                                f"concat('File has ''', declared, {q(chr(39) + ' extension but contains ' + what)})", description, raw_value=raw)
            + f" FROM h WHERE {where}"
        )

    picks = [
        pick("M1", f"{image} AND (regexp_matches(head, {q(mime.SVG_SIGNATURE)}) OR regexp_matches(head, {q(mime.XML_SIGNATURE)}))",
             "critical", "high", "mime_mismatch", "XML/SVG content",
             "concat('Named as an image (''', declared, ''') but the first bytes are XML or SVG.')",
             "concat('Declared: ', declared, ', Detected: XML/SVG')"),
        pick("M2", f"{image} AND regexp_matches(head, {q(mime.JS_SIGNATURE)})", "critical", "high", "polyglot_file", "JavaScript code",
             "'Named as an image but the first bytes declare JavaScript.'"),
        pick("M3", f"declared NOT IN ('.html', '.htm') AND regexp_matches(head, {q(mime.HTML_SIGNATURE)})", "high", "medium", "mime_mismatch",
             "HTML markup", "'HTML under a name that does not say so.'"),
        pick("M4", f"declared NOT IN ('.html', '.htm', '.svg', '.xml') AND regexp_matches(head, {q(mime.SCRIPT_SIGNATURE)})", "high", "medium",
             "polyglot_file", "<script> elements", "'Script element in a file that is neither HTML nor SVG.'"),
    ]
    return f"WITH s AS ({source}), h AS (SELECT *, {head} AS head FROM s) " + " UNION ALL ".join(picks)


DECLARED = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"


def entropy_sql() -> str:
    meaningful = (
        "length(dec) >= 10 AND length(regexp_replace(dec, '[^ -~]', '', 'g')) / length(dec) >= 0.7 "
        "AND regexp_matches(dec, '[A-Za-z]')"
    )
    shown = "printf('%.1f', ent)"
    return f"""WITH f AS ({seeded_sql()}), l AS ({lines_sql('f', TEXT_GATE)}),
v AS (SELECT * FROM (SELECT repo_id, path, line_no, stripped AS value FROM l)
      WHERE length(value) >= {entropy.MIN_LENGTH} AND regexp_full_match(value, '[A-Za-z0-9+/=]+')),
c AS (SELECT repo_id, path, line_no, value, ch, count(*) AS n FROM (SELECT *, unnest(string_split(value, '')) AS ch FROM v) GROUP BY ALL),
e AS (SELECT repo_id, path, line_no, value, round(-sum(n / length(value) * log2(n / length(value))), 9) AS ent FROM c GROUP BY ALL),
d AS (SELECT *, coalesce(try(decode(from_base64(value))), '') AS dec FROM e WHERE ent >= {entropy.THRESHOLD}),
m AS (SELECT *, coalesce({meaningful}, false) AS readable FROM d)
SELECT {finding("'E1'", "'high'", "'medium'", "'encoded_payload'", f"concat('High-entropy encoded string (entropy=', {shown}, ')')",
                "concat('Encoded string (', length(value), ' characters) which decodes to readable text')", "line_no",
                decoded=cut("dec", 300), raw_value=cut("value", 80))} FROM m WHERE readable
UNION ALL SELECT {finding("'E2'", "'medium'", "'low'", "'high_entropy'", f"concat('High-entropy string (entropy=', {shown}, ')')",
                          "concat('Dense string (', length(value), ' characters), perhaps a hidden payload')", "line_no",
                          raw_value=cut("value", 80))} FROM m WHERE NOT readable AND ent >= {entropy.HIGH_THRESHOLD}"""
