"""Rule evaluation: rule rows become native expressions over a files DataFrame.

Content rules of any number of families run in one narrow pass. Per file and rule a cheap literal test decides
whether the regular expression runs at all; only pieces of matching files leave the first projection.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import (
    explode_lines, fold_case, java_regex, locate_matches, strip, truncate,
)
from palisade.functions.urls import is_under, url_host
from palisade.rules.base import LineRule, Rule
from palisade.rules.network import CALL_URL, SAFE_HOSTS
from palisade.schema import as_findings


def _any(conditions: Sequence[Column]) -> Column:
    verdict = conditions[0]
    for c in conditions[1:]:
        verdict = verdict | c
    return verdict


_RULE_COLUMNS = (
    "rule_id string, analyzer string, severity string, confidence string, category string, title string, "
    "description string, cut int, tail string, snippet_cut int, before int, after int, cap int, with_line boolean, calls_url boolean"
)


def _rule_table(rules: Sequence[Rule | LineRule], index: Column) -> Column:
    """Metadata of the rule at ``index``; one literal that the optimizer folds to a constant array."""
    rows = []
    for r in rules:
        before, after, cap = getattr(r, "window", None) or (0, 0, 0)
        rows.append(
            {
                "rule_id": r.rule_id, "analyzer": r.analyzer, "severity": r.severity, "confidence": r.confidence,
                "category": r.category, "title": r.title, "description": r.description, "cut": r.cut,
                "tail": getattr(r, "tail", ""), "snippet_cut": getattr(r, "snippet_cut", 0), "before": before,
                "after": after, "cap": cap, "with_line": getattr(r, "with_line", True),
                "calls_url": getattr(r, "calls_url", False),
            }
        )
    return F.get(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_RULE_COLUMNS.replace(' ', ':').replace(',:', ',')}>>"), index)


def _literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gated(files: DataFrame, rules: Sequence[Rule], text: str, keep: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Files with their gates and folded text; for each rule a guard (gate and required literals) and its pattern, as SQL."""
    gates: dict[object, str] = {}
    for r in rules:
        gates.setdefault(r.gate, f"_gate{len(gates)}")
    prepared = files.select(*dict.fromkeys([*keep, text]), *[(gate() & (F.length(text) > 0)).alias(name) for gate, name in gates.items()])
    guards, patterns = [], []
    for r in rules:
        patterns.append(_literal(java_regex(r.pattern, r.ignore_case)))
        guard = gates[r.gate]
        for literals in (r.needles, r.also):
            if literals:
                guard += " AND (" + " OR ".join(f"contains(_folded, {_literal(n)})" for n in literals) + ")"
        guards.append(guard)
    return prepared.withColumn("_folded", fold_case(F.col(text))), guards, patterns


def occurrences(files: DataFrame, rules: Sequence[Rule], text: str = "content",
                keep: Sequence[str] = ("repo_id", "path")) -> DataFrame:
    """Every match of every rule: keep, rule (index into ``rules``), occurrence, start, line_no, matched, before, after.

    A pattern runs once over a file whose literals admit it, and once more, for the texts between, where it has matched.
    """
    keep = list(keep)
    prepared, guards, patterns = _gated(files, rules, text, keep)
    open_ = prepared.where(" OR ".join(dict.fromkeys(g.split(" AND ")[0] for g in guards)))
    branches = [
        f"CASE WHEN {guard} THEN struct({i} AS rule, regexp_extract_all({text}, {rx}, 0) AS hits) END"
        for i, (guard, rx) in enumerate(zip(guards, patterns))
    ]
    found = f"explode_outer(filter(array({', '.join(branches)}), h -> size(h.hits) > 0)) AS _hit"
    hit = open_.select(*dict.fromkeys([*keep, text]), F.expr(found)).where("_hit is not null")
    gaps = "CASE _hit.rule " + " ".join(f"WHEN {i} THEN split({text}, {rx}, -1)" for i, rx in enumerate(patterns)) + " END"
    return locate_matches(hit.select(*keep, "_hit.rule", F.expr(gaps).alias("gaps"), "_hit.hits"), [*keep, "rule"])


def severity_counts_of(files: DataFrame, rules: Sequence[Rule], text: str = "content") -> DataFrame:
    """repo_id, a count for each severity, total: matches of all rules per repository, clean repositories with zeros.

    One read of the files and one exchange, since files without a match stay as rows without a count.
    """
    prepared, guards, patterns = _gated(files, rules, text, ["repo_id"])
    branches = [
        f"CASE WHEN {guard} THEN struct({_literal(r.severity)} AS severity, size(regexp_extract_all({text}, {rx}, 0)) AS n) END"
        for r, guard, rx in zip(rules, guards, patterns)
    ]
    hits = prepared.select("repo_id", F.expr(f"explode_outer(filter(array({', '.join(branches)}), h -> h.n > 0)) AS _hit"))
    sums = [F.coalesce(F.sum(F.when(F.col("_hit.severity") == level, F.col("_hit.n"))), F.lit(0)).alias(level) for level in ("critical", "high", "medium", "low")]
    return hits.groupBy("repo_id").agg(*sums, F.coalesce(F.sum("_hit.n"), F.lit(0)).alias("total"))


def snippet_of(rule: Column, matched: Column = None) -> Column:
    matched = F.col("matched") if matched is None else matched
    window = F.concat(F.right("before", rule["before"]), matched, F.left("after", rule["after"]))
    cut = F.when(F.length(window) > rule["cap"], F.concat(F.left(window, rule["cap"]), F.lit("..."))).otherwise(window)
    return F.when(rule["cap"] > 0, cut)


def match_content(files: DataFrame, rules: Sequence[Rule], text: str = "content") -> DataFrame:
    """One finding per occurrence of each rule."""
    return findings_of(occurrences(files, rules, text), rules)


def findings_of(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of occurrences (repo_id, path, rule, line_no, matched, before, after)."""
    found = found.withColumn("_r", _rule_table(rules, F.col("rule")))
    rule = F.col("_r")
    url = F.lit(None).cast("string")
    if any(r.calls_url for r in rules):
        # The address inside the call is looked for with case, so HTTP:// counts as unknown.
        inner = F.regexp_extract("matched", java_regex(CALL_URL), 0)
        url = F.when(rule["calls_url"], F.when(inner != "", inner).otherwise("UNKNOWN"))
        found = found.withColumn("_url", url).where(~rule["calls_url"] | ~is_under(url_host(F.col("_url")), SAFE_HOSTS))
        url = F.col("_url")
    shown = F.when(
        F.length("matched") > rule["cut"], F.concat(F.left("matched", rule["cut"]), F.lit("..."))
    ).otherwise(F.col("matched"))
    return as_findings(
        found.select(
            "repo_id",
            "path",
            "_r.analyzer",
            "_r.rule_id",
            "_r.severity",
            "_r.confidence",
            "_r.category",
            "_r.title",
            F.when(url.isNotNull(), F.concat(rule["description"], url))
            .when(rule["cut"] > 0, F.concat(rule["description"], shown, rule["tail"]))
            .otherwise(rule["description"])
            .alias("description"),
            F.when(rule["with_line"], F.col("line_no")).alias("line_no"),
            snippet_of(rule).alias("snippet"),
            url.alias("raw_value"),
        )
    )


def match_lines(files: DataFrame, rules: Sequence[LineRule], text: str = "content") -> DataFrame:
    """One finding per line and rule."""
    gates: dict[object, str] = {}
    for r in rules:
        gates.setdefault(r.gate, f"_gate{len(gates)}")
    names = list(gates.values())
    gated = (
        files.where(F.length(text) > 0)
        .select("repo_id", "path", text, *[gate().alias(name) for gate, name in gates.items()])
        .where(_any([F.col(name) for name in names]))
    )
    lines = explode_lines(gated, text, ("repo_id", "path", *names)).withColumn("stripped", strip(F.col("line")))
    branches = []
    for i, r in enumerate(rules):
        guard = gates[r.gate]
        if r.stripped:
            guard += " AND stripped <> ''"
        if r.skip_comments:
            guard += " AND NOT startswith(stripped, '#')"
        target = "stripped" if r.stripped else "line"
        branches.append(
            f"CASE WHEN {guard} AND rlike({target}, {_literal(java_regex(r.pattern, r.ignore_case))}) THEN {i} END"
        )
    found = (
        lines.select("repo_id", "path", "line_no", "stripped", F.expr(f"explode_outer(array({', '.join(branches)})) AS rule"))
        .where("rule is not null")
        .withColumn("_r", _rule_table(rules, F.col("rule")))
    )
    rule = F.col("_r")

    def cut(limit: Column) -> Column:
        return F.when(
            F.length("stripped") > limit, F.concat(F.left("stripped", limit), F.lit("..."))
        ).otherwise(F.col("stripped"))

    lead = F.replace(rule["description"], F.lit("{line}"), F.col("line_no").cast("string"))
    return as_findings(
        found.select(
            "repo_id",
            "path",
            "_r.analyzer",
            "_r.rule_id",
            "_r.severity",
            "_r.confidence",
            "_r.category",
            "_r.title",
            F.concat(lead, cut(rule["cut"])).alias("description"),
            "line_no",
            F.when(rule["snippet_cut"] > 0, cut(rule["snippet_cut"])).otherwise(F.col("stripped")).alias("snippet"),
        )
    )


def match_file(files: DataFrame, patterns: Sequence[tuple[str, bool]], gate: Column, text: str = "content") -> DataFrame:
    """Files in which every pattern occurs; patterns are (regex, ignore case)."""
    verdict = gate & (F.length(text) > 0)
    for pattern, ignore_case in patterns:
        verdict = verdict & F.col(text).rlike(java_regex(pattern, ignore_case))
    return files.where(verdict)
