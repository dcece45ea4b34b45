"""Build script rules: Rust and Python packaging."""

from palisade.rules.base import LineRule, Rule, named

# Cargo.toml patterns.
CARGO_GIT = r"(?:git|repository)\s*=\s*[\"']([^\"']+)[\"']"
CARGO_BUILD = r"build\s*=\s*[\"']build\.rs[\"']"
CARGO_PROC_MACRO = r"(?:proc-macro|proc_macro)\s*=\s*true"

# Build.rs (id, pattern, severity, text, literals one of which every match holds); case matters.
BUILD_RS = [
    ("G4", r"(?:std::process::Command|Command::new|std::process::Stdio)", "high", "External command execution in build.rs", ("command", "stdio")),
    ("G5", r"(?:cc::Build|cmake|autotools|pkg_config)", "medium", "C/C++ code compilation in build script", ("cc::build", "cmake", "autotools", "pkg_config")),
    ("G6", r"(?:fs::write|fs::copy|fs::rename|std::fs::File::create)", "medium", "File system write in build script", ("fs::",)),
    ("G7", r"(?:download|url|http|https|reqwest|curl_easy)", "high", "Network request in build script — possible C2/downloader", ("download", "url", "http", "reqwest", "curl_easy")),
    ("G8", r"(?:env::var|env::set_var)", "low", "Environment variable access in build script", ("env::",)),
    ("G9", r"(?:include_bytes!|include_str!)", "low", "Compile-time file inclusion — may embed payloads", ("include_",)),
    ("G10", r"(?:unreachable|unsafe\s*\{)", "medium", "Unsafe code in build script — increased risk", ("unreachable", "unsafe")),
    ("G11", r"(?:std::os|libc)", "medium", "OS-level system calls in build script", ("std::os", "libc")),
]
# Setup.py (id, pattern, severity, text); case matters.
SETUP_PY = [
    ("H1", r"cmdclass\s*=\s*\{", "high", "Custom command classes override setuptools commands"),
    ("H2", r"distutils\.core\.setup|setuptools\.setup", "info", "Standard setup call"),
    ("H3", r"setup_requires\s*=\s*\[", "high", "Build-time dependency — runs during install"),
    ("H4", r"use_scm_version\s*=", "medium", "Dynamic version from git — may fetch remote"),
    ("H5", r"build_backend\s*=\s*[\"']", "medium", "Custom build backend — runs during build"),
    ("H6", r"os\.system\(|subprocess\.|shutil\.rmtree|shutil\.move|shutil\.copy", "critical", "System command execution in setup"),
    ("H7", r"requests\.get|urllib\.request|urllib2\.urlopen", "critical", "Network request in install script — potential C2/downloader"),
    ("H8", r"base64\.b64decode|base64\.b64encode", "high", "Base64 encoding in setup — obfuscation indicator"),
    ("H9", r"eval\(|exec\(|compile\(", "critical", "Dynamic code execution in setup script"),
    ("H10", r"__import__\(|importlib\.import_module\s*\(", "high", "Dynamic import — may load hidden modules"),
    ("H11", r"data_files\s*=\s*\[", "medium", "Installs files to arbitrary system paths"),
]
# Pyproject.toml (id, pattern, severity, text, literals); case matters.
PYPROJECT = [
    ("H12", r"build-backend\s*=\s*[\"']setuptools[^\"']*[\"']", "info", "Standard setuptools backend", ("build-backend",)),
    ("H13", r"build-backend\s*=\s*[\"'](?!setuptools)", "high", "Non-standard build backend — verify", ("build-backend",)),
    ("H14", r"requires\s*=\s*\[[\"'].*setup\.py", "high", "Build req includes setup.py — circular risk", ("setup.py",)),
]

CARGO_TOML_GATE = named("cargo.toml")

BUILD_RS_RULES = [
    Rule(
        rule_id=rule_id, analyzer="cargo", pattern=pattern, severity=severity, category="suspicious_command", title=text,
        needles=needles, description="build.rs uses '", cut=80, tail="' — this runs during cargo build.",
        window=(20, 40, 150), gate=named("build.rs"), priority=28,
    )
    for rule_id, pattern, severity, text, needles in BUILD_RS
]

PYTHON_LINE_RULES = [
    LineRule(
        rule_id=rule_id, analyzer="python_analyzer", pattern=pattern, severity=severity, category="suspicious_command",
        title=f"setup.py: {text}", description="Line {line} in setup.py: ", cut=150, snippet_cut=200,
        gate=named("setup.py"), priority=26,
    )
    for rule_id, pattern, severity, text in SETUP_PY
]

PYPROJECT_RULES = [
    Rule(
        rule_id=rule_id, analyzer="python_analyzer", pattern=pattern, severity=severity, category="suspicious_command",
        title=f"pyproject.toml: {text}", needles=needles, description="Found: ", cut=100, gate=named("pyproject.toml"),
        priority=26,
    )
    for rule_id, pattern, severity, text, needles in PYPROJECT
]
