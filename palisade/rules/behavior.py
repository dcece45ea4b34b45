"""Behaviour patterns: network, execution, persistence, exfiltration."""

from palisade.rules.base import Rule, text_files

# Fixed values: (group, category, title) and, per group, (pattern, severity, literals one of which every match holds).
GROUPS = {
    "network_behavior": ("behavioral_network", "Network communication — may phone home or download payloads"),
    "execution_behavior": ("behavioral_exec", "Code execution — runs commands or evaluates strings as code"),
    "persistence_behavior": ("behavioral_persistence", "Persistence mechanism — writes to disk or installs auto-start"),
    "exfiltration_behavior": ("behavioral_exfil", "Data exfiltration — reads secrets or sends data externally"),
}
PATTERNS = [
    ("B1", "network_behavior", r"https?://[^\s\"'<>)]+(?:download|payload|shell|backdoor|beacon|callback)", "critical", ("://",)),
    ("B2", "network_behavior", r"(?:curl|wget|fetch|http\.get|https\.get)\s*\(.*(?:http|https)", "high", ("http",)),
    ("B3", "network_behavior", r"new\s+XMLHttpRequest|new\s+WebSocket|new\s+EventSource", "high", ("xmlhttprequest", "websocket", "eventsource")),
    ("B4", "network_behavior", r"(?:nslookup|dig|ping)\s+[^\s]", "medium", ("nslookup", "dig", "ping")),
    ("B5", "network_behavior", r"/dev/tcp/|/dev/udp/", "critical", ("/dev/",)),
    ("B6", "network_behavior", r"(?:socket|connect|send|dgram)", "medium", ("socket", "connect", "send", "dgram")),
    ("B7", "execution_behavior", r"(?:eval|exec)\s*\([\"'][^\"']*[\"']\s*\)", "critical", ("eval", "exec")),
    ("B8", "execution_behavior", r"(?:child_process|execSync|spawn|spawnSync|execFile|fork)", "critical", ("child_process", "exec", "spawn", "fork")),
    ("B9", "execution_behavior", r"(?:os\.system|subprocess\.(?:call|Popen|run)|popen)", "critical", ("os.system", "subprocess.", "popen")),
    ("B10", "execution_behavior", r"(?:Runtime\.getRuntime\(\)\.exec|ProcessBuilder)", "critical", ("runtime.getruntime", "processbuilder")),
    ("B11", "execution_behavior", r"Function\s*\([\"'][^\"']*[\"']\)", "critical", ("function",)),
    ("B12", "execution_behavior", r"setTimeout\s*\([\"'][^\"']*[\"']", "medium", ("settimeout",)),
    ("B13", "execution_behavior", r"node\s+(?:-e|--eval)\s+[\"']", "high", ("node",)),
    ("B14", "execution_behavior", r"python\s+-c\s+[\"']", "high", ("python",)),
    ("B15", "persistence_behavior", r"(?:writeFile|writeFileSync|appendFile|createWriteStream|fwrite)", "high", ("writefile", "appendfile", "createwritestream", "fwrite")),
    ("B16", "persistence_behavior", r"(?:chmod|chown|attrib)\s+\+", "medium", ("chmod", "chown", "attrib")),
    ("B17", "persistence_behavior", r"(?:crontab|schtasks|at\s+|systemd)", "high", ("crontab", "schtasks", "at", "systemd")),
    ("B18", "persistence_behavior", r"(?:reg\s+add|REG ADD)", "high", ("reg",)),
    ("B19", "persistence_behavior", r"(?:nssm|srvany|winsw)", "high", ("nssm", "srvany", "winsw")),
    ("B20", "persistence_behavior", r"(?:Startup|StartupFolder|AutoRun)", "medium", ("startup", "autorun")),
    ("B21", "persistence_behavior", r"(?:\.bashrc|\.bash_profile|\.profile|\.zshrc)", "medium", (".bash", ".profile", ".zshrc")),
    ("B22", "exfiltration_behavior", r"(?:https?://[^\s\"'<>)]+\?(?:[^\s]*)(?:token|key|secret|pass|credential)=)", "critical", ("://",)),
    ("B23", "exfiltration_behavior", r"(?:cat|type|Get-Content)\s+.*(?:\.env|\.ssh|id_rsa|credential)", "critical", (".env", ".ssh", "id_rsa", "credential")),
    ("B24", "exfiltration_behavior", r"(?:env|printenv|echo)\s+\$?[A-Z_]*SECRET", "critical", ("secret",)),
    ("B25", "exfiltration_behavior", r"(?:process\.env\[|process\.env\.)", "medium", ("process.env",)),
    ("B26", "exfiltration_behavior", r"environ\[.*(?:TOKEN|KEY|SECRET|PASS)", "high", ("environ[",)),
    ("B27", "exfiltration_behavior", r"(?:ftp|sftp|scp)\s+[^\s]+@", "high", ("ftp", "scp")),
]
# Rules whose literals most texts with a link hold, and further literals, one of which every match holds as well.
ALSO = {
    "B1": ("download", "payload", "shell", "backdoor", "beacon", "callback"),
    "B2": ("curl", "wget", "fetch", ".get"),
    "B22": ("token=", "key=", "secret=", "pass=", "credential="),
}

RULES = [
    Rule(
        rule_id=rule_id, analyzer="behavioral", pattern=pattern, severity=severity, category=GROUPS[group][0],
        title=GROUPS[group][1], ignore_case=True, needles=needles, also=ALSO.get(rule_id, ()), description=f"Pattern '{group}': ", cut=120,
        window=(20, 40, 200), gate=text_files, priority=45,
    )
    for rule_id, group, pattern, severity, needles in PATTERNS
]
