"""Attack path and remediation by category, in our own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ADVICE = {
    "svg_event_handler": ("picture is rendered -> handler fires -> script runs", "Remove handlers and script links from pictures."),
    "svg_xxe": ("picture is parsed -> entity expands -> local file or service is read", "Remove the document type and parse with external entities off."),
    "svg_data_uri": ("data URI is loaded -> embedded content runs", "Remove data URIs with active content."),
    "svg_foreign_object": ("picture is rendered -> embedded HTML runs", "Remove foreign objects."),
    "zero_width_char": ("code looks harmless -> invisible characters change it", "Remove invisible characters."),
    "homoglyph": ("code looks right -> look-alike name binds elsewhere", "Write the identifier in ASCII."),
    "bidi_override": ("reviewer sees one order -> compiler sees another", "Remove direction control characters."),
    "obfuscated_script": ("reviewer cannot read it -> script runs", "Replace by readable code or remove."),
    "obfuscation_encoding": ("encoded text passes review -> tool decodes it", "Review and remove encoded text."),
    "high_entropy": ("unreadable data -> unknown content", "Find out what the string is."),
    "encoded_payload": ("string is decoded -> payload runs", "Decode and inspect; remove if unexplained."),
    "suspicious_js_api": ("input reaches an evaluating call -> code runs", "Avoid calls that turn text into code."),
    "suspicious_node_api": ("build parses the file -> server API runs", "Remove server APIs from assets."),
    "lifecycle_hook": ("package is installed -> hook runs", "Audit hooks; install with hooks disabled."),
    "suspicious_command": ("build runs -> command runs", "Remove the command or pin what it fetches."),
    "credential_theft": ("secret is published -> account is taken over", "Revoke the secret and keep it out of files."),
    "c2_callback": ("file is used -> address is contacted", "Remove the address or check its owner."),
    "runtime_network_call": ("code runs -> address is contacted", "Call known endpoints only."),
    "unpinned_action": ("upstream reference moves -> pipeline runs other code", "Pin to a full commit hash."),
    "ci_remote_exec": ("pipeline downloads -> unreviewed code runs", "Check in scripts or verify checksums."),
    "ci_secret_exposure": ("step prints or pipes a secret -> logs hold it", "Never echo or pipe secrets."),
    "postinstall_chain": ("package is installed -> hook downloads or executes", "Remove the hook or install without hooks."),
    "suspicious_dependency": ("dependency is resolved -> other code than expected", "Verify name, version and source."),
    "url_dependency": ("dependency is fetched from an address -> content may change", "Use the registry with integrity hashes."),
    "mime_mismatch": ("file is taken for another type -> active content runs", "Rename the file and review it."),
    "polyglot_file": ("file is valid as two types -> script runs", "Quarantine the file."),
    "behavioral_network": ("code runs -> network is used", "Audit; run isolated."),
    "behavioral_exec": ("code runs -> commands or text are executed", "Audit; run isolated."),
    "behavioral_persistence": ("code runs -> it stays on the machine", "Audit; run isolated."),
    "behavioral_exfil": ("code runs -> secrets leave the machine", "Audit; run isolated."),
    "policy_violation": ("known pattern is present -> treated as hostile", "Review the match."),
    "info": ("depends on context", "Review."),
}


def with_advice(findings: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for category, (path, fix) in ADVICE.items() for x in (category, path)]
    fixes = [F.lit(x) for category, (path, fix) in ADVICE.items() for x in (category, fix)]
    return findings.withColumns(
        {
            "attack_path": F.coalesce("attack_path", F.element_at(F.create_map(*pairs), F.col("category"))),
            "remediation": F.coalesce("remediation", F.element_at(F.create_map(*fixes), F.col("category"))),
        }
    )
