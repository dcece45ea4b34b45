"""Invisible characters, bidirectional overrides and look-alike letters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import context, explode_lines, file_name
from palisade.rules.base import text_files
from palisade.schema import as_findings

# Invisible characters and their names.
INVISIBLE = [
    ("\u200b", "U+200B ZERO WIDTH SPACE"),
    ("\u200c", "U+200C ZERO WIDTH NON-JOINER"),
    ("\u200d", "U+200D ZERO WIDTH JOINER"),
    ("\ufeff", "U+FEFF ZERO WIDTH NO-BREAK SPACE (BOM)"),
    ("\u2060", "U+2060 WORD JOINER"),
    ("\u2061", "U+2061 FUNCTION APPLICATION"),
    ("\u2062", "U+2062 INVISIBLE TIMES"),
    ("\u2063", "U+2063 INVISIBLE SEPARATOR"),
    ("\u2064", "U+2064 INVISIBLE PLUS"),
    ("\u202a", "U+202A LEFT-TO-RIGHT EMBEDDING"),
    ("\u202b", "U+202B RIGHT-TO-LEFT EMBEDDING"),
    ("\u202c", "U+202C POP DIRECTIONAL FORMATTING"),
    ("\u202d", "U+202D LEFT-TO-RIGHT OVERRIDE"),
    ("\u202e", "U+202E RIGHT-TO-LEFT OVERRIDE"),
    ("\u2066", "U+2066 LEFT-TO-RIGHT ISOLATE"),
    ("\u2067", "U+2067 RIGHT-TO-LEFT ISOLATE"),
    ("\u2068", "U+2068 FIRST STRONG ISOLATE"),
    ("\u2069", "U+2069 POP DIRECTIONAL ISOLATE"),
    ("\u180e", "U+180E MONGOLIAN VOWEL SEPARATOR"),
    ("\u00ad", "U+00AD SOFT HYPHEN"),
    ("\u034f", "U+034F COMBINING GRAPHEME JOINER"),
    ("\u061c", "U+061C ARABIC LETTER MARK"),
]
BIDI_OVERRIDES = ["\u202d", "\u202e", "\u2066", "\u2067", "\u2068", "\u2069"]
# Cyrillic letter and the Latin one it imitates; words worth imitating.
LOOK_ALIKES = [("\u0430", "a"), ("\u0435", "e"), ("\u043e", "o"), ("\u0441", "c"), ("\u0440", "p"), ("\u0445", "x"), ("\u0456", "i"), ("\u0455", "s")]
KEYWORDS = [
    "require", "import", "eval", "exec", "fetch", "http",
    "https", "localhost", "constructor", "prototype",
    "__proto__", "then", "catch", "async", "await",
]

GATE = text_files

_ANY_INVISIBLE = "[" + "".join(c for c, _ in INVISIBLE) + "]"

# One row per (keyword, letter pair) that changes the keyword; each yields its own finding.
DISGUISES = [
    (keyword, keyword.replace(latin, cyrillic))
    for keyword in KEYWORDS
    for cyrillic, latin in LOOK_ALIKES
    if latin in keyword
]


def quoted(text: Column) -> Column:
    """Characters as a Python literal shows them: invisible ones become \\u escapes, in single quotes."""
    shown = text
    for char, name in INVISIBLE:
        code = name[2:6].lower()
        escape = "\\x" + code[2:] if code.startswith("00") else "\\u" + code
        shown = F.replace(shown, F.lit(char), F.lit(escape))
    return F.concat(F.lit("'"), shown, F.lit("'"))


_TEXTS = {
    "U1": ("medium", "zero_width_char", "Invisible characters change what code does without showing in an editor."),
    "U2": ("high", "bidi_override", "Override characters make code read differently from how it runs (CVE-2021-42574)."),
    "U3": ("high", "homoglyph", ""),
}


def _sought(kinds: tuple[str, ...]) -> tuple[str, Column]:
    """A character class that every affected line meets, and the table of (rule, text, title, description) to look for."""
    marker, rows = "", []

    def row(rule_id: str, text: str, title: str, description: str) -> None:
        rows.append({"rule_id": rule_id, "text": text, "title": title, "description": description})

    if "U1" in kinds:
        marker += "".join(c for c, _ in INVISIBLE)
        for char, name in INVISIBLE:
            row("U1", char, f"Zero-width/invisible Unicode character: {name}", _TEXTS["U1"][2])
    if "U2" in kinds:
        marker += "".join(BIDI_OVERRIDES)
        for char in BIDI_OVERRIDES:
            row("U2", char, "Bidirectional text override character detected (Trojan Source)", _TEXTS["U2"][2])
    if "U3" in kinds:
        marker += "".join(c for c, _ in LOOK_ALIKES)
        for keyword, disguised in DISGUISES:
            row("U3", disguised, f"Homoglyph attack: '{keyword}' disguised with Cyrillic characters",
                f"'{disguised}' looks like '{keyword}' but is another identifier.")
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,text:string,title:string,description:string>>")
    return f"[{marker}]", table


def content_tricks(files: DataFrame, kinds: tuple[str, ...] = ("U1", "U2", "U3")) -> DataFrame:
    """Invisible characters and overrides on their first line per file, look-alike keywords on every line.

    One pass for all kinds: files and then lines without any of the characters drop out by one regular expression, and
    the first line comes from a minimum that is combined before the shuffle.
    """
    marker, table = _sought(kinds)
    lines = explode_lines(files.where(GATE() & F.col("content").rlike(marker))).where(F.col("line").rlike(marker))
    hits = lines.select(
        "repo_id", "path", "line_no", "line",
        F.explode_outer(F.filter(table, lambda t: F.contains(F.col("line"), t["text"]))).alias("t"),
    ).where("t is not null")
    first = (
        hits.select(
            "repo_id", "path", "line_no", "t", context(F.col("line"), F.col("t.text")).alias("snippet"),
            F.when(F.col("t.rule_id") == "U3", F.col("line_no")).alias("_each"),
        )
        .groupBy("repo_id", "path", "t", "_each")
        .agg(F.min(F.struct("line_no", "snippet")).alias("first"))
    )

    def by_rule(position: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, v in _TEXTS.items() for x in (k, v[position])]), F.col("t.rule_id"))

    return as_findings(
        first.select(
            "repo_id",
            "path",
            "t.rule_id",
            by_rule(0).alias("severity"),
            F.lit("high").alias("confidence"),
            by_rule(1).alias("category"),
            "t.title",
            "t.description",
            "first.line_no",
            "first.snippet",
            F.when(F.col("t.rule_id") != "U3", quoted(F.col("t.text"))).alias("raw_value"),
        ),
        "unicode",
    )


def invisible_characters(files: DataFrame) -> DataFrame:
    return content_tricks(files, ("U1",))


def bidi_overrides(files: DataFrame) -> DataFrame:
    return content_tricks(files, ("U2",))


def homoglyphs(files: DataFrame) -> DataFrame:
    return content_tricks(files, ("U3",))


def suspicious_file_names(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    marked = files.where(GATE() & (F.col("size") > 0) & name.rlike(_ANY_INVISIBLE)).select(
        "repo_id", "path", name.alias("name")
    )
    invisible = F.transform(
        F.filter(
            F.array(*[F.struct(F.lit(c).alias("char"), F.lit(n).alias("label")) for c, n in INVISIBLE]),
            lambda t: F.contains(F.col("name"), t["char"]),
        ),
        lambda t: F.struct(
            F.lit("U4").alias("rule_id"), F.lit("high").alias("severity"),
            F.concat(F.lit("Filename contains invisible Unicode character: "), t["label"]).alias("title"),
        ),
    )
    overriding = F.transform(
        F.filter(F.array(*[F.lit(c) for c in BIDI_OVERRIDES]), lambda c: F.contains(F.col("name"), c)),
        lambda c: F.struct(
            F.lit("U5").alias("rule_id"), F.lit("critical").alias("severity"),
            F.lit("Filename contains bidi override character (Trojan Source in filename)").alias("title"),
        ),
    )
    found = marked.select("repo_id", "path", "name", F.explode_outer(F.concat(invisible, overriding)).alias("f")).where("f is not null")
    return as_findings(
        found.select(
            "repo_id",
            "path",
            "f.rule_id",
            "f.severity",
            F.lit("high").alias("confidence"),
            F.lit("bidi_override").alias("category"),
            "f.title",
            F.concat(F.lit("File "), quoted(F.col("name")), F.lit(" is shown under a name it does not have.")).alias("description"),
            quoted(F.col("name")).alias("raw_value"),
        ),
        "unicode",
    )


def detect_unicode(files: DataFrame) -> DataFrame:
    return content_tricks(files).unionByName(suspicious_file_names(files))
