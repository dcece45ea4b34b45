"""Build and install scripts, and the scripts section of package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import truncate
from palisade.operators.dependencies import merged_npm_versions, npm_manifests
from palisade.operators.matching import occurrences
from palisade.rules.base import Rule, everything
from palisade.schema import as_findings

# File names and suffixes; lifecycle hooks that npm runs on its own.
FILE_NAMES = (
    "package.json", "makefile", "dockerfile", "docker-compose.yml",
    "docker-compose.yaml", "install.sh", "build.sh", "deploy.sh", "entrypoint.sh",
)
SUFFIXES = (".sh", ".bash", ".ps1", ".bat")
LIFECYCLE_HOOKS = ("preinstall", "install", "postinstall", "preuninstall", "uninstall")
# Fixed values: (id, pattern, severity, text, literals one of which every match holds). Patterns meet lower-cased
# text; with strict_case those that spell capitals never match.
PATTERNS = [
    ("C1", r"curl\s+[-]\w*\s*[SO]", "high", "Curl with silent/output flags", ("curl",)),
    ("C2", r"wget\s+[-]\w*\s*[qO]", "high", "Wget with quiet/output flags", ("wget",)),
    ("C3", r"(?:curl|wget)\s+.*\|\s*(?:bash|sh|powershell|cmd|python)", "critical", "Remote script piped directly to shell", ("curl", "wget")),
    ("C4", r"node\s+-(?:e|eval)\s+[\"']", "high", "Node inline evaluation", ("node",)),
    ("C5", r"python\s+-c\s+[\"']", "medium", "Python inline code execution", ("python",)),
    ("C6", r"(?:child_process|execSync|exec\s*\()", "critical", "Node.js process execution", ("child_process", "exec")),
    ("C7", r"(?:fs\.writeFile|writeFileSync|appendFile|createWriteStream)", "high", "File write from script", ("writefile", "appendfile", "createwritestream")),
    ("C8", r"(?:chmod\s+777|chmod\s+\+x)", "high", "Permission modification", ("chmod",)),
    ("C9", r"(?:base64|atob|btoa|fromCharCode)", "medium", "Encoding/obfuscation functions", ("base64", "atob", "btoa", "fromcharcode")),
    ("C10", r"(?:env\.(?:SECRET|TOKEN|KEY|PASS|CREDENTIAL))", "critical", "Access to environment secrets", ("env.",)),
    ("C11", r"(?:process\.env)", "low", "Environment variable access", ("process.env",)),
    ("C12", r"(?:sudo)", "medium", "Sudo execution", ("sudo",)),
    ("C13", r"(?:git\s+clone\s+https?://[^@]+@)", "critical", "Git clone with embedded credentials", ("clone",)),
    ("C14", r"(?:npx|npm)\s+(?:exec|run)\s+.*(?:https?://)", "high", "Package execution from remote URL", ("npx", "npm")),
    ("C15", r"(?:docker\s+run|docker\s+build)", "medium", "Container execution", ("docker",)),
    ("C16", r"(?:/dev/tcp/|/dev/udp/)", "critical", "Bash TCP/UDP redirection", ("/dev/",)),
    ("C17", r"(?:powershell\s+-(?:EncodedCommand|e)\s+)", "high", "PowerShell encoded command", ("powershell",)),
    ("C18", r"(?:cat|type|Get-Content)\s+.*(?:\.env|\.ssh|id_rsa|credentials|token|secret)", "critical", "Credential file exfiltration", (".env", ".ssh", "id_rsa", "credentials", "token", "secret")),
    ("C19", r"(?:env|printenv|echo)\s+.*(?:SECRET|TOKEN|PASS|API_KEY)", "critical", "Environment variable exfiltration", ("secret", "token", "pass", "api_key")),
    ("C20", r"(?:ls\s+-la\s+~/.ssh|cat\s+~/.ssh/authorized_keys)", "critical", "SSH key enumeration", ("ssh",)),
]
URL_PREFIXES = ("http://", "https://", "git+")


def GATE() -> Column:
    name = F.lower(F.substring_index("path", "/", -1))
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | F.endswith(F.col("path"), F.lit(s))
    return name.isin(*FILE_NAMES) | suffix


def script_texts(files: DataFrame) -> DataFrame:
    """What to match: whole script files, and each string under ``scripts`` of a package manifest."""
    gated = files.where(GATE() & (F.length("content") > 0))
    is_manifest = F.lower(F.substring_index("path", "/", -1)) == "package.json"
    whole = gated.where(~is_manifest).select("repo_id", "path", F.lit(None).cast("string").alias("script"), F.col("content").alias("text"))
    return whole.unionByName(manifest_scripts(gated).select("repo_id", "path", "script", "text"))


def manifest_scripts(files: DataFrame) -> DataFrame:
    return npm_manifests(files).select(
        "repo_id", "path", F.explode_outer("manifest.scripts").alias("script", "_value")
    ).where(F.schema_of_variant("_value") == "STRING").select(
        "repo_id", "path", "script", F.variant_get("_value", "$", "string").alias("text")
    )


def command_findings(files: DataFrame, strict_case: bool = False) -> DataFrame:
    rules = [
        Rule(i, "script_analyzer", p, sev, "suspicious_command", title, ignore_case=not strict_case, needles=n, gate=everything)
        for i, p, sev, title, n in PATTERNS
    ]
    texts = script_texts(files).withColumn("lowered", F.lower("text"))
    hits = occurrences(texts, rules, "lowered", ["repo_id", "path", "text"])

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))

    # The excerpt keeps the case of the file: same offsets, original text.
    begin = F.greatest(F.col("start") - 30, F.lit(0))
    window = F.substring("text", begin + 1, F.col("start") + F.length("matched") + 30 - begin)
    return as_findings(
        hits.select(
            "repo_id",
            "path",
            "line_no",
            pick([r.rule_id for r in rules]).alias("rule_id"),
            pick([r.severity for r in rules]).alias("severity"),
            F.lit("medium").alias("confidence"),
            F.lit("suspicious_command").alias("category"),
            pick([r.title for r in rules]).alias("title"),
            F.concat(F.lit("Matched pattern: "), truncate(F.col("matched"), 120)).alias("description"),
            truncate(window, 200).alias("snippet"),
        ),
        "script_analyzer",
    )


def lifecycle_findings(files: DataFrame) -> DataFrame:
    hooks = manifest_scripts(files).where(F.col("script").isin(*LIFECYCLE_HOOKS))
    return as_findings(
        hooks.select(
            "repo_id",
            "path",
            F.lit("C21").alias("rule_id"),
            F.lit("info").alias("severity"),
            F.lit("high").alias("confidence"),
            F.lit("lifecycle_hook").alias("category"),
            F.concat(F.lit("Package has '"), "script", F.lit("' lifecycle script")).alias("title"),
            F.concat(F.lit("Installing the package runs: "), truncate(F.col("text"), 200)).alias("description"),
            F.col("text").alias("snippet"),
        ),
        "script_analyzer",
    )


def url_dependency_findings(files: DataFrame) -> DataFrame:
    """Dependencies whose version is an address; as elsewhere the later section wins for a repeated name."""
    # A manifest whose scripts entry is no object is not looked at further.
    deps = merged_npm_versions(files).where("version is not null and (_scripts is null or startswith(_scripts, '{'))")
    is_url = F.lit(False)
    for prefix in URL_PREFIXES:
        is_url = is_url | F.startswith(F.col("version"), F.lit(prefix))
    return as_findings(
        deps.where(is_url).select(
            "repo_id",
            "path",
            F.lit("C23").alias("rule_id"),
            F.lit("critical").alias("severity"),
            F.lit("high").alias("confidence"),
            F.lit("url_dependency").alias("category"),
            F.concat(F.lit("Dependency '"), "name", F.lit("' resolved from URL: "), truncate(F.col("version"), 100)).alias("title"),
            F.lit("A version that is an address bypasses the registry and can change at any time.").alias("description"),
            F.col("version").alias("raw_value"),
        ),
        "script_analyzer",
    )


def detect_scripts(files: DataFrame, strict_case: bool = False) -> DataFrame:
    return (
        command_findings(files, strict_case)
        .unionByName(lifecycle_findings(files))
        .unionByName(url_dependency_findings(files))
    )
