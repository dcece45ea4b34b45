"""Dependency inventory and its detectors: manifests, lock files, look-alike names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.functions.text import explode_lines, java_regex, strip, truncate
from palisade.operators.joins import salted_join
from palisade.schema import as_findings

# Popular names that others imitate.
POPULAR = [
    "lodash", "react", "express", "axios", "chalk", "moment",
    "request", "async", "bluebird", "underscore", "colors",
    "commander", "body-parser", "mongoose", "passport",
    "socket.io", "jsdom", "cheerio", "babel", "webpack",
    "gulp", "grunt", "yargs", "inquirer", "ora", "glob",
    "rimraf", "mkdirp", "uuid", "debug", "winston", "morgan",
    "cors", "dotenv", "jsonwebtoken", "bcrypt", "ejs", "pug",
    "helmet", "compression", "cookie-parser", "multer",
    "nodemailer", "joi", "validator", "cross-env", "cross-spawn",
    "faker", "chance", "prettier", "eslint", "tslib",
]
PREFIXES = ["node-", "js-", "nodejs-", "lib-", "native-"]
SUFFIXES = ["-js", "-node", "-lib", "-native", "-util", "-helper"]
NAME_FRAGMENTS = [
    "postinstall-", "preinstall-", "install-", "*-backdoor",
    "electron-native-", "node-native-", "*-malware", "payload-",
    "crypto-", "crypt-", "decrypt-", "decoding-",
]
HOOK_PATTERN = r"(?:curl|wget|fetch|https?://|download|chmod|chown|/dev/tcp|eval|exec|base64|python|node)"
HOOKS = ["postinstall", "preinstall", "install"]
VERSION_PATTERNS = [
    (r"https?://[^\s\"']+", "critical", "URL-resolved package version"),
    (r"git\+https?://[^\s\"']+", "critical", "Git URL dependency (unpinned)"),
    (r"file://[^\s\"']+", "high", "Local file dependency"),
    (r"^\*$", "low", "Wildcard version (unstable)"),
    (r"^[A-Za-z0-9+/]{40,}=*$", "critical", "Base64 version string"),
    (r"[|;&`$]", "critical", "Shell metacharacters in version string"),
]
NPM_REGISTRY = "registry.npmjs.org"
YARN_REGISTRIES = (NPM_REGISTRY, "registry.yarnpkg.com")
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
MIN_RATIO = 0.75

DEPENDENCY_FILES = (
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "pipfile",
    "pipfile.lock", "gemfile", "gemfile.lock", "go.mod", "go.sum",
)

ANALYZER = "dependency"


def _named(*names: str) -> Column:
    return F.lower(F.substring_index("path", "/", -1)).isin(*names) & (F.length("content") > 0)


# ---- npm manifests -------------------------------------------------------------------------------------------------

def npm_manifests(files: DataFrame) -> DataFrame:
    """Package manifests, parsed once; values keep their JSON type so that non-strings can be told apart."""
    schema = "struct<scripts:map<string,variant>," + ",".join(f"{s}:map<string,variant>" for s in NPM_SECTIONS) + ">"
    return files.where(_named("package.json")).select(
        "repo_id", "path", F.from_json("content", schema).alias("manifest"),
        F.get_json_object("content", "$.scripts").alias("_scripts"),
    )


def _variant_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def _own_entries(section: str, taken: Column) -> Column:
    """Entries of one section whose name no later section repeats."""
    own = F.filter(F.map_entries(F.col(f"manifest.{section}")), lambda e: ~F.array_contains(taken, e["key"]))
    return F.transform(
        own, lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("value"))
    )


def merged_npm_versions(files: DataFrame) -> DataFrame:
    """repo_id, path, section, name, version (null if not text). A name in several sections keeps the last one.

    The merge is per manifest and stays inside its row; no shuffle.
    """
    parts = []
    for i, section in enumerate(NPM_SECTIONS):
        later = [F.coalesce(F.map_keys(F.col(f"manifest.{s}")), F.array().cast("array<string>")) for s in NPM_SECTIONS[i + 1:]]
        taken = F.concat(*later) if later else F.array().cast("array<string>")
        parts.append(_own_entries(section, taken))
    rows = npm_manifests(files).select(
        "repo_id", "path", "_scripts", F.explode_outer(F.flatten(F.array_compact(F.array(*parts)))).alias("d")
    ).where("d is not null")
    return rows.select("repo_id", "path", "d.section", "d.name", _variant_text(F.col("d.value")).alias("version"), "_scripts")


def npm_deps(files: DataFrame) -> DataFrame:
    """Dependency rows of npm manifests; a version that is not text counts as any version."""
    return merged_npm_versions(files).select(
        "repo_id", "path", "section", "name", F.coalesce("version", F.lit("*")).alias("version")
    )


def _found(rule_id: str, severity: Column, confidence: str, title: Column, description: Column, raw: Column,
           category: str = "suspicious_dependency") -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"), severity.alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit(category).alias("category"), title.alias("title"), description.alias("description"), raw.alias("raw_value"),
    )


def dependency_findings(deps: DataFrame) -> DataFrame:
    """Name and version rules over dependency rows, in one pass."""
    name, version = F.col("name"), F.col("version")
    base = F.substring_index("name", "/", -1)
    low = F.lower(base)
    pinned = F.concat(name, F.lit("@"), version)
    popular = F.array(*[F.lit(p) for p in POPULAR])

    scoped = F.transform(
        F.filter(F.array(name), lambda n: F.startswith(n, F.lit("@")) & F.contains(n, F.lit("/"))),
        lambda n: _found("D2", F.lit("info"), "low",
                         F.concat(F.lit("Scoped package '"), n, F.lit("' — verify it resolves to the right registry")),
                         F.lit("An unconfigured private scope falls back to the public registry."), n),
    )
    prefixed = F.transform(
        F.filter(
            F.array(*[F.lit(p) for p in PREFIXES]),
            lambda p: F.startswith(low, p) & F.array_contains(popular, F.substring(low, F.length(p) + 1, F.length(low))),
        ),
        lambda p: _found("D4", F.lit("high"), "medium",
                         F.concat(F.lit("Suspicious prefix on '"), name, F.lit("': '"), p, F.lit("' added to '"),
                                  F.substring(base, F.length(p) + 1, F.length(base)), F.lit("'")),
                         F.concat(F.lit("'"), p, F.lit("' before a popular name is a common squatting pattern.")), pinned),
    )
    suffixed = F.transform(
        F.filter(
            F.array(*[F.lit(s) for s in SUFFIXES]),
            lambda s: F.endswith(low, s) & F.array_contains(popular, F.substring(low, F.lit(1), F.length(low) - F.length(s))),
        ),
        lambda s: _found("D5", F.lit("high"), "medium",
                         F.concat(F.lit("Suspicious suffix on '"), name, F.lit("': adds '"), s, F.lit("' to '"),
                                  F.substring(base, F.lit(1), F.length(base) - F.length(s)), F.lit("'")),
                         F.concat(F.lit("'"), s, F.lit("' after a popular name is a common squatting pattern.")), pinned),
    )
    fragments = F.transform(
        F.filter(
            F.array(*[F.lit(f) for f in NAME_FRAGMENTS]),
            lambda f: F.contains(F.lower(name), F.replace(f, F.lit("*"), F.lit(""))),
        ),
        lambda f: _found("D6", F.lit("high"), "medium",
                         F.concat(name, F.lit(": Package name contains suspicious pattern '"), f, F.lit("'")),
                         F.concat(F.lit("Dependency '"), name, F.lit("'@"), version,
                                  F.lit(": name matches suspicious pattern '"), f, F.lit("'.")), pinned),
    )
    versions = F.array_compact(
        F.array(
            *[
                F.when(
                    version.rlike(java_regex(pattern)),
                    _found("D7", F.lit(severity), "high", F.concat(name, F.lit(": " + text)),
                           F.concat(F.lit("Dependency '"), name, F.lit("' version '"), version,
                                    F.lit("' triggered: " + text)), version),
                )
                for pattern, severity, text in VERSION_PATTERNS
            ]
        )
    )
    rows = deps.select(
        "repo_id", "path", F.explode_outer(F.concat(scoped, prefixed, suffixed, fragments, versions)).alias("f")
    ).where("f is not null")
    return as_findings(rows.select("repo_id", "path", "f.*"), ANALYZER)


def hook_findings(files: DataFrame) -> DataFrame:
    """Install hooks whose command downloads, decodes or executes."""
    hooks = npm_manifests(files).select(
        "repo_id", "path", F.explode_outer("manifest.scripts").alias("hook", "_value")
    ).where(F.col("hook").isin(*HOOKS)).select("repo_id", "path", "hook", _variant_text(F.col("_value")).alias("command"))
    return as_findings(
        hooks.where(F.col("command").rlike(java_regex(HOOK_PATTERN, True))).select(
            "repo_id",
            "path",
            F.lit("D8").alias("rule_id"),
            F.lit("high").alias("severity"),
            F.lit("high").alias("confidence"),
            F.lit("postinstall_chain").alias("category"),
            F.concat(F.lit("Package has '"), "hook", F.lit("' script with suspicious operations")).alias("title"),
            F.concat(F.lit("The install step runs: "), truncate(F.col("command"), 200)).alias("description"),
            F.col("command").alias("snippet"),
        ),
        ANALYZER,
    )


def manifest_errors(files: DataFrame) -> DataFrame:
    """Manifests whose install hook is not text; their other findings are kept."""
    hooks = npm_manifests(files).select(
        "repo_id", "path", F.explode_outer("manifest.scripts").alias("hook", "_value")
    ).where(F.col("hook").isin(*HOOKS) & (F.schema_of_variant("_value") != "STRING"))
    return hooks.select(
        "repo_id", "path", F.lit(ANALYZER).alias("analyzer"),
        F.concat(F.lit("install hook '"), "hook", F.lit("' is not text")).alias("message"),
    )


# ---- look-alike names ----------------------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def similarity(names: pd.Series, popular: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; argument order matters, the measure is not symmetric."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(names, popular)])


# Not moved or repeated by the optimizer: a filter on the result must not run the function twice.
similarity = similarity.asNondeterministic()


def _can_reach(name: Column, popular: Column) -> Column:
    """Upper bounds of the ratio: by length, then by shared letters counted with multiplicity."""
    total = F.length(name) + F.length(popular)
    by_length = 2 * F.least(F.length(name), F.length(popular)) / total >= MIN_RATIO

    def count(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    shared = F.aggregate(
        F.array_distinct(F.split(popular, "")), F.lit(0),
        lambda acc, letter: acc + F.least(count(name, letter), count(popular, letter)),
    )
    return F.when(by_length, 2 * shared / total >= MIN_RATIO).otherwise(False)


def lookalikes(names: DataFrame) -> DataFrame:
    """base, popular, ratio for distinct ``base`` names. The popular list is a constant of 52; bounds drop nearly all
    pairs before they become rows, and only the rest is compared exactly."""
    candidates = names.select(
        "base",
        F.explode_outer(
            F.filter(F.array(*[F.lit(p) for p in POPULAR]), lambda p: _can_reach(F.lower("base"), p))
        ).alias("popular"),
    ).where("popular is not null")
    return candidates.select(
        "base", "popular", similarity(F.lower("base"), F.col("popular")).alias("ratio")
    ).where((F.col("ratio") >= MIN_RATIO) & (F.col("ratio") < 1.0))


def typosquat_findings(deps: DataFrame) -> DataFrame:
    """Names are reduced to distinct ones before the comparison and joined back afterwards."""
    keyed = deps.withColumn("base", F.substring_index("name", "/", -1))
    close = lookalikes(keyed.select("base").distinct())
    percent = F.format_string("%.0f%%", F.bround(F.col("ratio") * 100, 0))
    return as_findings(
        salted_join(keyed, close, ["base"]).select(
            "repo_id",
            "path",
            F.lit("D3").alias("rule_id"),
            F.lit("high").alias("severity"),
            F.lit("medium").alias("confidence"),
            F.lit("suspicious_dependency").alias("category"),
            F.concat(F.lit("Possible typo-squatting: '"), "name", F.lit("' is similar to '"), "popular", F.lit("' ("), percent, F.lit(")")).alias("title"),
            F.concat(F.lit("Dependency '"), "name", F.lit("'@"), "version", F.lit(" resembles the popular package '"), "popular", F.lit("'.")).alias("description"),
            F.concat("name", F.lit("@"), "version").alias("raw_value"),
        ),
        ANALYZER,
    )


# ---- lock files ----------------------------------------------------------------------------------------------------

def npm_lock_packages(files: DataFrame) -> DataFrame:
    """repo_id, path, package, name, resolved, integrity of npm lock files; the root entry is left out."""
    schema = "struct<packages:map<string,struct<resolved:string,integrity:string>>>"
    rows = files.where(_named("package-lock.json")).select(
        "repo_id", "path", F.explode_outer(F.from_json("content", schema)["packages"]).alias("package", "info")
    ).where("package <> ''")
    return rows.select(
        "repo_id", "path", "package", F.substring_index("package", "node_modules/", -1).alias("name"),
        "info.resolved", "info.integrity",
    )


def npm_lock_findings(files: DataFrame) -> DataFrame:
    resolved, integrity = F.col("resolved"), F.col("integrity")
    checks = F.array(
        F.when(
            (resolved != "") & ~F.contains(resolved, F.lit(NPM_REGISTRY)),
            _found("D10", F.lit("critical"), "high",
                   F.concat(F.lit("Lockfile resolved URL outside registry: "), truncate(resolved, 100)),
                   F.concat(F.lit("Package '"), "name", F.lit("' resolves to '"), resolved, F.lit("', which is another place than the public registry.")),
                   resolved, "url_dependency"),
        ),
        F.when(
            (integrity != "") & ~F.startswith(integrity, F.lit("sha")),
            _found("D11", F.lit("high"), "high",
                   F.concat(F.lit("Suspicious integrity hash: "), truncate(integrity, 60)),
                   F.concat(F.lit("Package '"), "package", F.lit("' carries a checksum of unknown kind: "), integrity),
                   F.lit(None).cast("string")),
        ),
    )
    rows = npm_lock_packages(files).select("repo_id", "path", F.explode_outer(checks).alias("f")).where("f is not null")
    return as_findings(rows.select("repo_id", "path", "f.*"), ANALYZER)


def pipfile_lock_findings(files: DataFrame) -> DataFrame:
    schema = "struct<default:map<string,variant>,develop:map<string,variant>>"
    parsed = files.where(_named("pipfile.lock")).select("repo_id", "path", F.from_json("content", schema).alias("lock"))
    entries = F.flatten(F.array_compact(F.array(F.map_entries("lock.default"), F.map_entries("lock.develop"))))
    version = F.try_variant_get(F.col("e.value"), "$.version", "variant")
    rows = parsed.select("repo_id", "path", F.explode_outer(entries).alias("e")).where("e is not null").select(
        "repo_id", "path", F.col("e.key").alias("name"), _variant_text(version).alias("version")
    ).where(F.contains(F.col("version"), F.lit("://")))
    return as_findings(
        rows.select(
            "repo_id",
            "path",
            F.lit("D17").alias("rule_id"),
            F.lit("high").alias("severity"),
            F.lit("medium").alias("confidence"),
            F.lit("url_dependency").alias("category"),
            F.concat(F.lit("Pipfile.lock URL dependency: "), "name", F.lit(" -> "), truncate(F.col("version"), 100)).alias("title"),
            F.concat(F.lit("Package '"), "name", F.lit("' takes its version from an address: "), "version").alias("description"),
            F.concat("name", F.lit("=="), "version").alias("raw_value"),
        ),
        ANALYZER,
    )


# Lock files read line by line (id, file name, marker, allowed hosts, severity, confidence, title, description).
LOCK_LINES = [
    ("D12", "yarn.lock", "resolved ", YARN_REGISTRIES, "critical", "high", "Yarn lockfile resolves to external URL: ", "Package resolved to non-registry URL: "),
    ("D16", "pnpm-lock.yaml", "resolved:", (NPM_REGISTRY,), "critical", "high", "pnpm lockfile resolves to external URL: ", "Package resolved to non-registry URL: "),
    ("D18", "gemfile.lock", "remote:", ("rubygems.org",), "medium", "low", "Gemfile.lock remote outside rubygems.org: ", "Lockfile uses non-standard remote: "),
]


def line_findings(files: DataFrame) -> DataFrame:
    """All line-based manifests and lock files in one pass over their lines."""
    file = F.lower(F.substring_index("path", "/", -1))
    names = [row[1] for row in LOCK_LINES] + ["requirements.txt", "pipfile", "gemfile", "go.mod", "go.sum"]
    gated = files.where(_named(*names)).select("repo_id", "path", file.alias("file"), "content")
    lines = explode_lines(gated, keep=("repo_id", "path", "file")).withColumn("text", strip(F.col("line")))
    text = F.col("text")

    def on(name: str) -> Column:
        return F.col("file") == name

    def has(literal: str) -> Column:
        return F.contains(text, F.lit(literal))

    def begins(literal: str) -> Column:
        return F.startswith(text, F.lit(literal))

    def entry(rule_id: str, condition: Column, severity: str, confidence: str, category: str, title: Column,
              description: Column, raw: Column | None = None) -> Column:
        located = raw is None
        return F.when(
            condition,
            F.struct(
                F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
                F.lit(category).alias("category"), title.alias("title"), description.alias("description"),
                (F.col("line_no") if located else F.lit(None).cast("int")).alias("line_no"),
                (text if located else F.lit(None).cast("string")).alias("snippet"),
                (F.lit(None).cast("string") if located else raw).alias("raw_value"),
            ),
        )

    checks = []
    for rule_id, name, marker, hosts, severity, confidence, title, description in LOCK_LINES:
        url = F.btrim(strip(F.substring_index("text", marker, -1)), F.lit("\"'"))
        outside = F.lit(True)
        for host in hosts:
            outside = outside & ~F.contains(url, F.lit(host))
        checks.append(
            entry(rule_id, on(name) & begins(marker) & has("https://") & outside, severity, confidence, "url_dependency",
                  F.concat(F.lit(title), truncate(url, 100)), F.concat(F.lit(description), url), url)
        )
    pip_line = (
        F.col("file").isin("requirements.txt", "pipfile")
        & (text != "") & ~begins("#") & ~begins("//")
        & (~begins("-") | begins("-e "))
    )
    checks += [
        entry("D13", pip_line & has("@") & has("://"), "high", "medium", "url_dependency",
              F.concat(F.lit("Python dependency from URL: "), truncate(text, 100)),
              F.lit("A dependency by address bypasses the index.")),
        entry("D14", pip_line & (begins("-e ") | has(" --editable")), "medium", "medium", "suspicious_dependency",
              F.lit("Editable pip install — can execute arbitrary setup.py"),
              F.concat(F.lit("Editable install: "), truncate(text, 100))),
        entry("D15", on("gemfile") & (has("git:") | has("github:") | has("path:")), "medium", "low", "suspicious_dependency",
              F.concat(F.lit("Ruby gem from non-standard source: "), truncate(text, 100)),
              F.lit("Gems from elsewhere than the registry can bring untrusted code.")),
        entry("D19", on("go.mod") & begins("replace ") & has("=>"), "medium", "low", "suspicious_dependency",
              F.concat(F.lit("Go module replace directive: "), truncate(text, 120)),
              F.lit("A replaced module may come from a fork or a local path.")),
        entry("D20", on("go.mod") & begins("// ") & F.contains(F.lower(text), F.lit("indirect")) & has("://"), "info", "low",
              "suspicious_dependency", F.concat(F.lit("Go module comment references URL: "), truncate(text, 120)),
              F.lit("A comment on an indirect dependency holds an address.")),
    ]
    fields = F.split(text, r"(?U)[\s\x1c-\x1f]+")
    algorithm = F.get(fields, F.lit(2))
    checks.append(
        entry("D21", on("go.sum") & (F.size(fields) >= 3) & ~F.startswith(algorithm, F.lit("h1:")), "low", "low",
              "suspicious_dependency", F.concat(F.lit("Non-standard go.sum hash: "), truncate(algorithm, 40)),
              F.concat(F.lit("Module '"), F.get(fields, F.lit(0)), F.lit("@"), F.get(fields, F.lit(1)),
                       F.lit("' uses non-standard hash: "), algorithm))
    )
    rows = lines.select("repo_id", "path", F.explode_outer(F.array(*checks)).alias("f")).where("f is not null")
    return as_findings(rows.select("repo_id", "path", "f.*"), ANALYZER)


def detect_deps(files: DataFrame) -> DataFrame:
    deps = npm_deps(files)
    return (
        dependency_findings(deps)
        .unionByName(typosquat_findings(deps))
        .unionByName(hook_findings(files))
        .unionByName(npm_lock_findings(files))
        .unionByName(pipfile_lock_findings(files))
        .unionByName(line_findings(files))
    )
