"""Unicode clean-up columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import explode_lines

# Fixed values.
ZERO_WIDTH = (
    "\u200b\u200c\u200d\ufeff\u2060"
    "\u2061\u2062\u2063\u2064"
    "\u2066\u2067\u2068\u2069"
    "\u202a\u202b\u202c\u202d\u202e"
    "\u180e\u00ad\u034f\u061c"
)
BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o",
    "\u0441": "c", "\u0440": "p", "\u0445": "x",
    "\u0456": "i", "\u0455": "s",
    "\u0432": "b", "\u043a": "k", "\u043c": "m",
    "\u043d": "h", "\u0442": "t", "\u0443": "y",
}


def strip_invisible(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def strip_bidi(text: Column) -> Column:
    return F.translate(text, BIDI, "")


def normalize_homoglyphs(text: Column) -> Column:
    return F.translate(text, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def count_invisible(text: Column) -> Column:
    return F.length(text) - F.length(strip_invisible(text))


def trojan_lines(files: DataFrame) -> DataFrame:
    """One row per line and bidi character on it: repo_id, path, line_no, code_point."""
    table = F.array(
        *[F.struct(F.lit(c).alias("char"), F.lit(f"Bidi override U+{ord(c):04X}").alias("label")) for c in BIDI]
    )
    lines = explode_lines(files.where(F.col("content").rlike(f"[{BIDI}]")))
    return lines.select(
        "repo_id", "path", "line_no",
        F.explode_outer(F.filter(table, lambda t: F.contains(F.col("line"), t["char"]))).alias("t"),
    ).where("t is not null").select("repo_id", "path", "line_no", F.col("t.label").alias("code_point"))
