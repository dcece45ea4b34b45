"""Built-in malware pattern set."""

from palisade.rules.base import Rule, text_files

# Fixed values: (id, rule name, pattern, severity, description, literals one of which every match holds).
# All but the first ignore case.
PATTERNS = [
    ("Y1", "base64_payload", r"[A-Za-z0-9+/]{100,}={0,2}", "medium", "Large base64-encoded blob with executable indicators", ()),
    ("Y2", "powershell_encoded", r"powershell\s+.*(?:-e|-enc|-encodedcommand)\s+[A-Za-z0-9+/]{20,}", "critical", "PowerShell encoded command detected", ("powershell",)),
    ("Y3", "reverse_shell", r"(?:bash|sh|nc|ncat)\s+-(?:i|e)\s*(?:\d+\s+)?(?:>&|>|<\s*/dev/tcp/)", "critical", "Reverse shell command detected", ("-i", "-e")),
    ("Y4", "vba_macro", r"(?:Sub\s+AutoOpen|Sub\s+Auto_Open|Workbook_Open|Document_Open|VBA\.)", "high", "VBA macro or AutoOpen detected", ("autoopen", "auto_open", "workbook_open", "document_open", "vba.")),
    ("Y5", "php_webshell", r"(?:system\(|shell_exec\(|passthru\(|exec\(|assert\(|eval\s*\(\s*\$_)", "critical", "PHP webshell indicator", ("system(", "exec(", "passthru(", "assert(", "eval")),
    ("Y6", "sql_injection", r"(?:SELECT\s+\S+\s+FROM\s+\S+\s+WHERE\s+\S+\s*=\s*[\"']\s*[\"']?\s*\+|UNION\s+SELECT\s+--\s|exec\s*\(\s*[\"']SELECT)", "high", "SQL injection pattern in code", ("select",)),
    ("Y7", "dynamic_import", r"(?:require|import)\s*\(\s*(?:[a-zA-Z_$][a-zA-Z0-9_$]*\s*\+|`.*\$\{)", "high", "Dynamically constructed import/require", ("require", "import")),
    ("Y8", "hidden_process", r"(?:CreateProcessWithLogon|CreateProcessAsUser|NtUnmapViewOfSection|Process\.Start\s*\(\s*[^)]*\s*\)\s*\.\s*Start)", "critical", "Process hiding technique", ("createprocess", "ntunmapviewofsection", "process.start")),
    ("Y9", "scheduled_task", r"(?:schtasks\s*/create|schtasks\s*/change|ScheduledTasks|Register-ScheduledJob)", "high", "Scheduled task creation for persistence", ("schtasks", "scheduledtasks", "register-scheduledjob")),
    ("Y10", "ioc_http_user_agent", r"(?:User-Agent|useragent)\s*:\s*[\"'](?:Mozilla|curl|wget)[^\"']{0,10}", "medium", "Custom User-Agent header — possible C2 communication", ("user-agent", "useragent")),
]

RULES = [
    Rule(
        rule_id=rule_id, analyzer="yara", pattern=pattern, severity=severity, category="policy_violation",
        title=f"Pattern match: {name}", ignore_case=rule_id != "Y1", needles=needles, description=description,
        window=(20, 40, 150), gate=text_files, slow=True, priority=7,
    )
    for rule_id, name, pattern, severity, description, needles in PATTERNS
]
