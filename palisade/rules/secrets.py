"""Credential formats that providers document publicly, and generic assignments."""

from pyspark.sql import functions as F

from palisade.rules.base import Rule

# Lock files hold hashes by the thousand and are skipped.
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "gemfile.lock", "poetry.lock", "composer.lock",
)

# Fixed values: (id, pattern, severity, title, literals one of which every match holds). Case matters unless marked.
PATTERNS = [
    ("K1", r"\bAKIA[0-9A-Z]{16}\b", "critical", "AWS access key ID", ("akia",)),
    ("K2", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "critical", "GitHub token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("K3", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", "critical", "Private key block", ("private key",)),
    ("K4", r"\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqps?)://[^\s:@/\"']+:[^\s@/\"']+@[^\s\"']+", "high", "Database URL with credentials", ("://",)),
    ("K5", r"\bxox[abprs]-[0-9A-Za-z-]{10,}", "critical", "Slack token", ("xox",)),
    ("K6", r"(?i)\b(?:token|secret|api_?key)\s*[:=]\s*[\"'][A-Za-z0-9_\-./+=]{16,}[\"']", "high", "Assigned secret or token", ("token", "secret", "key")),
    ("K7", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "high", "JSON Web Token", ("eyj",)),
    ("K8", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{32,}", "critical", "OpenAI API key", ("sk-",)),
    ("K9", r"\bAIza[0-9A-Za-z_-]{35}", "critical", "Google API key", ("aiza",)),
    ("K10", r"\b[sr]k_live_[0-9A-Za-z]{24,}\b", "critical", "Stripe live key", ("k_live_",)),
    ("K11", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "critical", "SendGrid API key", ("sg.",)),
    ("K12", r"\bSK[0-9a-f]{32}\b", "high", "Twilio API key", ("sk",)),
    ("K13", r"\bnpm_[A-Za-z0-9]{36}\b", "critical", "npm access token", ("npm_",)),
    ("K14", r"\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", "critical", "PyPI upload token", ("pypi-",)),
    ("K15", r"\bglpat-[A-Za-z0-9_-]{20,}", "critical", "GitLab access token", ("glpat-",)),
    ("K16", r"\bAccountKey=[A-Za-z0-9+/]{86}==", "critical", "Azure storage account key", ("accountkey=",)),
    ("K17", r"\bdop_v1_[0-9a-f]{64}\b", "critical", "DigitalOcean token", ("dop_v1_",)),
    ("K18", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+", "high", "Slack webhook URL", ("hooks.slack.com",)),
    ("K19", r"\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", "high", "Telegram bot token", (":aa",)),
    ("K20", r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}\b", "critical", "Shopify access token", ("shp",)),
    ("K21", r"\bGOCSPX-[A-Za-z0-9_-]{28}", "critical", "Google OAuth client secret", ("gocspx-",)),
    ("K22", r"\bkey-[0-9a-z]{32}\b", "high", "Mailgun API key", ("key-",)),
]

# Further literals, one of which every match holds as well.
ALSO = {"K4": ("postgres", "mysql", "mariadb", "mongodb", "redis", "amqp"), "K6": ("\"", "'")}


def _not_a_lock_file():
    return F.col("is_text") & ~F.lower(F.substring_index("path", "/", -1)).isin(*LOCK_FILES)


RULES = [
    Rule(
        rule_id=rule_id, analyzer="secrets", pattern=pattern, severity=severity, category="credential_theft",
        title=title, confidence="high" if severity == "critical" else "medium", needles=needles, also=ALSO.get(rule_id, ()),
        description="Matches the documented format: ", cut=60, window=(20, 40, 150), gate=_not_a_lock_file, slow=True,
        priority=8,
    )
    for rule_id, pattern, severity, title, needles in PATTERNS
]
