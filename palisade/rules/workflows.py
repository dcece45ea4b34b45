"""CI pipeline rules."""

from pyspark.sql import Column, functions as F

from palisade.rules.base import LineRule, Rule

# Fixed values: (id, pattern, severity, text). W1-W4 respect case, the others do not.
PINNING = [
    ("W1", r"uses:\s+[^@]+@main", "medium", "Action pinned to 'main' branch — mutable reference"),
    ("W2", r"uses:\s+[^@]+@master", "medium", "Action pinned to 'master' branch — mutable reference"),
    ("W3", r"uses:\s+[^@]+@\d+", "low", "Action pinned only by major version — may auto-update"),
    ("W4", r"uses:\s+[^@]+@[0-9a-f]{7}\b", "low", "Short commit hash — may be ambiguous"),
]
REMOTE_EXEC = [
    ("W5", r"run:\s*.*(?:curl|wget)\s+.*\|\s*(?:bash|sh|powershell)", "critical", "Remote script piped to shell in CI"),
    ("W6", r"run:\s*.*(?:curl|wget)\s+-[SO].*\s*&&\s*(?:bash|sh|./)", "critical", "Download then execute pattern in CI"),
    ("W7", r"run:\s*.*(?:npx|npm)\s+exec\s+.*https?://", "high", "Package execution from URL in CI"),
    ("W8", r"run:\s*.*docker\s+run\s+.*(?:bash|sh|curl)", "medium", "Container execution in CI step"),
    ("W9", r"run:\s*.*(?:chmod\s+\+x|chmod\s+777)", "medium", "Permission modification in CI"),
]
SECRETS = [
    ("W10", r"run:\s*.*echo\s+\$\{\{?\s*secrets\.", "critical", "Secrets printed to CI logs"),
    ("W11", r"env:\s*\n.*(?:SECRET|TOKEN|KEY|PASS|CREDENTIAL)\s*:", "high", "Secret-like environment variable defined in workflow"),
    ("W12", r"\$\{\{?\s*secrets\.\w+\s*\}?\}\s*\|", "critical", "Secret piped to other commands — potential exfiltration"),
]
ACTIONS = [
    ("W13", r"actions/checkout@", "info", "Standard checkout action"),
    ("W14", r"actions/upload-artifact@", "low", "Artifact upload — verify what's uploaded"),
    ("W15", r"actions/download-artifact@", "low", "Artifact download — verify source"),
    ("W16", r"docker://", "medium", "Docker-based action — verify image source"),
]
SELF_HOSTED = r"runs-on:\s*[\"']?\[?self-hosted\]?"
REUSABLE = r"uses:\s+([^@]+)@([^\s]+)"
UPLOAD = r"actions/upload-artifact@"
DOWNLOAD = r"actions/download-artifact@"
DISPATCH = r"(?:workflow_dispatch|repository_dispatch|workflow_call)"
SCHEDULE = r"schedule:\s*\n"
CRON = r"cron:"


def GATE() -> Column:
    """Pipeline definitions. Jenkinsfile and .circleci/config.yml are matched on the lower-cased path as intended."""
    path = F.lower("path")
    name = F.substring_index(path, "/", -1)
    return (
        name.isin("action.yml", "action.yaml", ".gitlab-ci.yml", ".gitlab-ci.yaml", "azure-pipelines.yml", "jenkinsfile")
        | F.contains(path, F.lit(".github/workflows/"))
        | (path == ".circleci/config.yml")
        | path.endswith("/.circleci/config.yml")
    )


def _lines(rows, category, confidence, title, description, cut, ignore_case=True):
    return [
        LineRule(
            rule_id=rule_id, analyzer="workflow", pattern=pattern, severity=severity, category=category,
            title=f"{title}: {text}", confidence=confidence, ignore_case=ignore_case, stripped=False,
            description=description, cut=cut, gate=GATE, priority=30,
        )
        for rule_id, pattern, severity, text in rows
    ]


LINE_RULES = [
    *_lines(PINNING, "unpinned_action", "medium", "Unpinned action reference", "Line: ", 150, ignore_case=False),
    *_lines(REMOTE_EXEC, "ci_remote_exec", "high", "CI remote execution", "A pipeline step runs what it fetches: ", 200),
    *_lines(SECRETS, "ci_secret_exposure", "high", "CI secrets exposure", "A secret may leave the pipeline here: ", 200),
    *_lines(ACTIONS, "info", "low", "CI action", "Action reference: ", 100),
]

RULES = [
    Rule(
        rule_id="W18", analyzer="workflow", pattern=SELF_HOSTED, severity="high", category="info",
        title="Workflow targets self-hosted runners", ignore_case=True, needles=("self-hosted",),
        description="Own runners often keep state and reach the internal network.", gate=GATE,
        priority=30,
    ),
]
