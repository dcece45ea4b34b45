"""SVG inspection: scripts, handlers, entities, data URIs, foreign objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.decode import strict_base64_text
from palisade.functions.text import java_regex, explode_lines, strip, truncate
from palisade.operators.matching import occurrences
from palisade.rules.base import Rule
from palisade.schema import as_findings

# Fixed values.
EVENTS = [
    "onload", "onunload", "onerror", "onclick", "ondblclick",
    "onmousedown", "onmouseup", "onmouseover", "onmousemove",
    "onmouseout", "onfocus", "onblur", "onsubmit", "onreset",
    "onkeydown", "onkeypress", "onkeyup", "onchange",
    "onloadstart", "onprogress", "ontimeout", "onplay",
]
EXEC_CALLS = [
    "eval(", "exec(", "Function(", "setTimeout(", "setInterval(",
    "new Function", "document.write(", "document.writeln(",
    "import(", "require(", "fetch(", "XMLHttpRequest(",
    "WebSocket(", "ActiveXObject(", "atob(", "btoa(",
    "unescape(", "escape(", "decodeURI(", "decodeURIComponent(",
]
CRITICAL_CALLS = ["eval(", "exec(", "Function("]
# Compared with lower-cased text as they stand, so the mixed-case ones match only without ``strict_case``.
NODE_APIS = [
    "child_process", "execSync", "exec(", "spawn(",
    "writeFileSync", "writeFile(", "appendFile(",
    "createWriteStream", "fs.write", "net.connect",
    "dgram.createSocket", "http.request", "https.request",
]
OBFUSCATION = [
    r"\\x[0-9a-fA-F]{2}", r"\\u[0-9a-fA-F]{4}", r"String\.fromCharCode", r"charCodeAt",
    r"_0x[0-9a-fA-F]{4,}", r"split\([\"']{2}\)", r"join\([\"']{2}\)", r"parseInt\(str",
    r"substr\(.*?\)", r"replace\(\.\+", r"concat\(.*?\)", r"prototype\s*=", r"__proto__",
]
CDN_HOSTS = [
    "cdn.jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com",
    "code.jquery.com", "maxcdn.bootstrapcdn.com", "stackpath.bootstrapcdn.com",
    "fonts.googleapis.com", "ajax.googleapis.com",
    "cdn.skypack.dev", "esm.sh",
]
DATA_URI_MARKERS = ["script", "eval(", "onload", "javascript:", "fetch("]
FOREIGN_MARKERS = ["<script", "onload", "onerror", "javascript:"]

DOCTYPE = r"<!DOCTYPE\s+\w+\s*\["
ENTITY = r"<!ENTITY\s+\w+\s+(SYSTEM|PUBLIC)\s+"
SCRIPT = r"(?s:<script[^>]*>(.*?)</script>)"
HANDLER = "(?:" + "|".join(EVENTS) + r")\s*=\s*([\"'])(.*?)\1"
DATA_URI = r"data:(?:text/html|text/javascript|application/javascript|image/svg\+xml)(?:;base64)?,([^\"')\s]+)"
FOREIGN = r"(?s:<foreignObject[^>]*>(.*?)</foreignObject>)"
JS_LINK = r"href\s*=\s*([\"'])\s*javascript:([^\"']+)\1"
EXTERNAL_LINK = r"(?:href|xlink:href)\s*=\s*([\"'])(https?://[^\"']+)\1"
CSS_EXPRESSION = r"(?:expression|javascript)\s*:"
SCRIPT_URL = r"https?://([^\s\"'<>)]+)"
ENCODED_CALL = r"(?:btoa|atob)\s*\(\s*([\"'])([A-Za-z0-9+/=]{20,})\1\s*\)"
LONG_BASE64 = r"([A-Za-z0-9+/]{20,}={0,2})"

MIN_OBFUSCATED, MIN_INDICATORS, MIN_LINE = 40, 2, 20


def GATE() -> Column:
    return F.col("is_svg") | (F.col("detected_mime") == "image/svg+xml")


def is_obfuscated(text: Column) -> Column:
    score = F.lit(0)
    for pattern in OBFUSCATION:
        score = score + text.rlike(java_regex(pattern)).cast("int")
    return (F.length(text) >= MIN_OBFUSCATED) & (score >= MIN_INDICATORS)


def embedded_base64(text: Column) -> Column:
    """What the first decodable atob/btoa literal says, else the first long base64 run."""
    literals = F.transform(
        F.regexp_extract_all(text, F.lit(java_regex(ENCODED_CALL)), F.lit(2)), strict_base64_text
    )
    run = F.regexp_extract(text, java_regex(LONG_BASE64), 1)
    return F.coalesce(
        F.get(F.filter(literals, lambda d: d.isNotNull()), F.lit(0)),
        F.when(run != "", strict_base64_text(run)),
    )


def _has_any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower(text), m))


def _rule(rule_id: str, pattern: str, needle: str) -> Rule:
    return Rule(rule_id, "svg_vector", pattern, "high", "info", "", ignore_case=True, needles=(needle,), gate=GATE)


def external_entities(files: DataFrame) -> DataFrame:
    found = files.where(
        GATE() & F.col("content").rlike(java_regex(DOCTYPE, True)) & F.col("content").rlike(java_regex(ENTITY, True))
    )
    return as_findings(
        found.select(
            "repo_id", "path",
            F.lit("V1").alias("rule_id"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"),
            F.lit("svg_xxe").alias("category"),
            F.lit("SVG contains XML External Entity (XXE) declaration").alias("title"),
            F.lit("An external entity can read local files or reach internal services when parsed.").alias("description"),
        ),
        "svg_vector",
    )


def script_bodies(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, body of every non-empty script element."""
    return occurrences(files, [_rule("V2", SCRIPT, "<script")]).select(
        "repo_id", "path", "line_no", strip(F.regexp_extract("matched", java_regex(SCRIPT, True), 1)).alias("body")
    ).where("body <> ''")


def script_findings(files: DataFrame, strict_case: bool = False) -> DataFrame:
    body = F.col("body")
    low = F.lower(body)

    def entry(rule_id: str, severity, confidence: str, category: str, title: Column, description: Column,
              snippet: Column, raw: Column) -> Column:
        return F.struct(
            F.lit(rule_id).alias("rule_id"), severity.alias("severity"), F.lit(confidence).alias("confidence"),
            F.lit(category).alias("category"), title.alias("title"), description.alias("description"),
            snippet.alias("snippet"), raw.alias("raw_value"),
        )

    none = F.lit(None).cast("string")
    shown = truncate(body, 300)
    obfuscated = F.transform(
        F.filter(F.array(F.lit("SVG <script> contains obfuscated JavaScript")), lambda _: is_obfuscated(body)),
        lambda t: entry("V2", F.lit("high"), "high", "obfuscated_script", t,
                        F.lit("Escapes or encodings hide from a reader what the script does."), shown, none),
    )
    calls = F.transform(
        F.filter(F.array(*[F.lit(c) for c in EXEC_CALLS]), lambda c: F.contains(low, F.lower(c))),
        lambda c: entry("V3", F.when(c.isin(*CRITICAL_CALLS), "critical").otherwise("high"), "high", "suspicious_js_api",
                        F.concat(F.lit("SVG script uses '"), c, F.lit("' — can execute arbitrary code")),
                        F.concat(F.lit("'"), c, F.lit("' evaluates strings as code or decodes payloads.")), shown, none),
    )
    apis = F.transform(
        F.filter(
            F.array(*[F.lit(a) for a in NODE_APIS]),
            lambda a: F.contains(low, a if strict_case else F.lower(a)),
        ),
        lambda a: entry("V4", F.lit("critical"), "medium", "suspicious_node_api",
                        F.concat(F.lit("SVG script uses Node.js API '"), a, F.lit("'")),
                        F.lit("A server runtime is expected, so the script is meant to run at build time."), shown, none),
    )
    urls = F.filter(
        F.regexp_extract_all(body, F.lit(java_regex(SCRIPT_URL)), F.lit(1)),
        lambda u: ~F.substring_index(u, "/", 1).isin(*CDN_HOSTS),
    )
    remote = F.transform(
        urls,
        lambda u: entry("V5", F.lit("high"), "medium", "runtime_network_call",
                        F.lit("SVG script phones home to external URL"),
                        F.concat(F.lit("Script contacts "), u, F.lit(", which may be a control server or serve a payload.")), none, u),
    )
    found = script_bodies(files).select(
        "repo_id", "path", "line_no", F.explode_outer(F.concat(obfuscated, calls, apis, remote)).alias("f")
    ).where("f is not null")
    return as_findings(found.select("repo_id", "path", "line_no", "f.*"), "svg_vector")


# Fixed values: (id, pattern, literal of which every match holds one).
ATTRIBUTES = [
    ("V6", HANDLER, "on"),
    ("V8", DATA_URI, "data:"),
    ("V9", FOREIGN, "<foreignobject"),
    ("V10", JS_LINK, "javascript:"),
    ("V12", EXTERNAL_LINK, "href"),
    ("V13", CSS_EXPRESSION, ":"),
]


def attribute_findings(files: DataFrame) -> DataFrame:
    """Handlers, data URIs, foreign objects, links and style expressions, in one pass."""
    rules = [_rule(rule_id, pattern, needle) for rule_id, pattern, needle in ATTRIBUTES]
    which = F.get(F.array(*[F.lit(r.rule_id) for r in rules]), F.col("rule"))

    def group(rule_id: str, index: int) -> Column:
        pattern = next(p for i, p, _ in ATTRIBUTES if i == rule_id)
        return F.regexp_extract("matched", java_regex(pattern, True), index)

    value = (
        F.when(which == "V6", group("V6", 2))
        .when(which == "V8", group("V8", 1))
        .when(which == "V9", group("V9", 1))
        .when(which == "V10", group("V10", 2))
        .when(which == "V12", group("V12", 2))
    )
    hits = occurrences(files, rules).select("repo_id", "path", "line_no", "matched", which.alias("rule_id"), value.alias("value"))
    hits = hits.withColumn("decoded", F.when(F.col("rule_id").isin("V6", "V8"), embedded_base64(F.col("value"))))
    hits = hits.where(
        F.when(F.col("rule_id") == "V8", F.col("decoded").isNotNull() & _has_any(F.col("decoded"), DATA_URI_MARKERS))
        .when(F.col("rule_id") == "V9", _has_any(F.col("value"), FOREIGN_MARKERS))
        .otherwise(True)
    )

    def by_rule(**values: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule_id, v in values.items():
            out = F.when(F.col("rule_id") == rule_id, v).otherwise(out)
        return out

    value = F.col("value")
    handler = F.concat(F.lit("Inline '"), F.substring_index("matched", "=", 1), F.lit("' handler executes JS"))
    first = hits.select(
        "repo_id", "path", "line_no", "rule_id",
        by_rule(V6=F.lit("high"), V8=F.lit("critical"), V9=F.lit("high"), V10=F.lit("high"), V12=F.lit("low"),
                V13=F.lit("high")).alias("severity"),
        by_rule(V6=F.lit("high"), V8=F.lit("high"), V9=F.lit("medium"), V10=F.lit("high"), V12=F.lit("low"),
                V13=F.lit("medium")).alias("confidence"),
        by_rule(V6=F.lit("svg_event_handler"), V8=F.lit("svg_data_uri"), V9=F.lit("svg_foreign_object"),
                V10=F.lit("svg_event_handler"), V12=F.lit("c2_callback"), V13=F.lit("svg_event_handler")).alias("category"),
        by_rule(V6=handler, V8=F.lit("Data URI contains executable JS"),
                V9=F.lit("SVG <foreignObject> sneaks in executable HTML/JS"), V10=F.lit("javascript: URI in SVG link"),
                V12=F.lit("SVG links to external URL"),
                V13=F.lit("CSS expression or javascript: in style context")).alias("title"),
        by_rule(V6=F.concat(F.lit("Handler: "), truncate(value, 200)),
                V8=F.concat(F.lit("Decodes to: "), truncate(F.col("decoded"), 200)),
                V9=F.lit("Embedded HTML with active content inside the picture."),
                V10=F.concat(F.lit("Link executes: "), truncate(value, 200)),
                V12=F.concat(F.lit("External resource: "), value),
                V13=F.lit("Style expressions run code in some renderers.")).alias("description"),
        by_rule(V6=value, V10=value).alias("snippet"),
        by_rule(V12=value).alias("raw_value"),
        "decoded",
    )
    # A handler that decodes to an eval call is reported once more, as a payload.
    payload = F.struct(
        F.lit("V7").alias("rule_id"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"),
        F.lit("encoded_payload").alias("category"), F.lit("Base64-encoded eval in SVG event handler").alias("title"),
        F.lit("The handler decodes to an eval() call.").alias("description"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("raw_value"),
    )
    same = F.struct("rule_id", "severity", "confidence", "category", "title", "description", "snippet", "raw_value")
    is_payload = (F.col("rule_id") == "V6") & F.contains(F.lower("decoded"), F.lit("eval"))
    both = first.select(
        "repo_id", "path", "line_no", "decoded",
        F.explode(F.when(is_payload, F.array(same, payload)).otherwise(F.array(same))).alias("f"),
    )
    return as_findings(both.select("repo_id", "path", "line_no", "decoded", "f.*"), "svg_vector")


def obfuscated_lines(files: DataFrame) -> DataFrame:
    """Obfuscated lines that are not a whole script body."""
    bodies = F.transform(
        F.regexp_extract_all("content", F.lit(java_regex(SCRIPT, True)), F.lit(1)), strip
    )
    gated = files.where(GATE() & (F.length("content") > 0)).select("repo_id", "path", "content", bodies.alias("bodies"))
    lines = explode_lines(gated, keep=("repo_id", "path", "bodies")).withColumn("line", strip(F.col("line")))
    found = lines.where(
        (F.length("line") >= MIN_LINE) & is_obfuscated(F.col("line")) & ~F.array_contains("bodies", F.col("line"))
    )
    return as_findings(
        found.select(
            "repo_id", "path", "line_no",
            F.lit("V11").alias("rule_id"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"),
            F.lit("obfuscation_encoding").alias("category"),
            F.lit("Obfuscated string outside <script> tags").alias("title"),
            F.concat(F.lit("Line contains obfuscation indicators: "), truncate(F.col("line"), 200)).alias("description"),
            F.col("line").alias("snippet"),
        ),
        "svg_vector",
    )


def detect_svg(files: DataFrame, strict_case: bool = False) -> DataFrame:
    return (
        external_entities(files)
        .unionByName(script_findings(files, strict_case))
        .unionByName(attribute_findings(files))
        .unionByName(obfuscated_lines(files))
    )
