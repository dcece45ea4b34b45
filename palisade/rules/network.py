"""Runtime network calls."""

from palisade.rules.base import Rule, text_files

# Hosts that calls may reach.
SAFE_HOSTS = (
    "github.com", "gitlab.com", "bitbucket.org",
    "npmjs.org", "npmjs.com", "yarnpkg.com",
    "registry.npmjs.org", "registry.yarnpkg.com",
    "unpkg.com", "cdn.jsdelivr.net", "cdnjs.cloudflare.com",
    "fonts.googleapis.com", "fonts.gstatic.com",
    "nodejs.org", "python.org", "pypi.org",
    "rubygems.org", "crates.io", "nuget.org",
    "maven.org", "mvnrepository.com",
)
# Runtime calls (id, pattern, label, literals one of which every match holds); case is ignored.
NETWORK_CALLS = [
    ("N12", r"fetch\s*\(\s*[\"']https?://[^\"']+[\"']", "fetch()", ("fetch",)),
    ("N13", r"XMLHttpRequest\s*\(", "XMLHttpRequest", ("xmlhttprequest",)),
    ("N14", r"(?:axios|got|request|superagent)\s*[.\(]", "HTTP library", ("axios", "got", "request", "superagent")),
    ("N15", r"new\s+WebSocket\s*\(\s*[\"']wss?://", "WebSocket", ("websocket",)),
    ("N16", r"new\s+EventSource\s*\(\s*[\"']https?://", "EventSource", ("eventsource",)),
    ("N17", r"import\s*\(\s*[\"']https?://[^\"']+[\"']", "dynamic import", ("import",)),
    ("N18", r"require\s*\(\s*[\"']https?://[^\"']+[\"']", "require URL", ("require",)),
    ("N19", r"new\s+Worker\s*\(\s*[\"']https?://", "Worker from URL", ("worker",)),
]
CALL_URL = r"https?://[^\"')]+"

RULES = [
    Rule(
        rule_id=rule_id, analyzer="url_network", pattern=pattern, severity="high", category="runtime_network_call",
        title=f"Runtime network call via {label}", ignore_case=True, needles=needles,
        description="Code makes network request to: ", calls_url=True, gate=text_files, priority=40,
    )
    for rule_id, pattern, label, needles in NETWORK_CALLS
]
