"""Content rules over huge texts by ranges, with the matches of the whole text.

Literals are tried on the whole text first; only the rules that they admit go on. A text is cut into ranges of equal length; each is
matched with some context on both sides, by a task of its own, and owns the matches that start in it. Lines are counted by sums over
the ranges. Three things make the result that of the whole text:

* Reach. What a match and its look-around may span is bounded by the pattern's fixed parts and, for each open repetition of one kind
  of character, by the longest run of that kind in this very text. Where the sum is within the overlap, the rule runs on ranges.
* Step. Matches do not overlap, so where one starts depends on the one before. Two neighbours must agree on the matches in the
  last ``overlap`` characters before their border; then the scan goes on from the same place as over the whole text.
* Rest. A text and rule that fail either test are matched whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from re import _constants as sre, _parser as parser

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.text import LOOK_AHEAD, LOOK_BEHIND, java_regex
from palisade.operators.matching import _gated, findings_of, occurrences
from palisade.rules.base import Rule
from palisade.storage import run_folder

RANGE_CHARS, OVERLAP = 65_536, 8192
KEY = ["repo_id", "path"]
_CATEGORIES = {
    sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S", sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D",
    sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W",
}


@dataclass(frozen=True)
class Reach:
    """Characters that a match spans at most, besides runs of the given kinds (character classes, once for each repetition)."""

    fixed: int = 0
    runs: tuple[str, ...] = ()

    def __add__(self, other: Reach) -> Reach:
        return Reach(self.fixed + other.fixed, self.runs + other.runs)


def _kind(item: tuple) -> str | None:
    """One character's class as a pattern; None if the item is not a single character."""
    op, value = item
    if op is sre.ANY:
        return r"[^\n]"
    if op is sre.LITERAL:
        return re.escape(chr(value))
    if op is sre.NOT_LITERAL:
        return f"[^{re.escape(chr(value))}]"
    if op is not sre.IN:
        return None
    out = ""
    for kind, what in value:
        if kind is sre.NEGATE:
            out += "^"
        elif kind is sre.LITERAL:
            out += re.escape(chr(what))
        elif kind is sre.RANGE:
            out += f"{re.escape(chr(what[0]))}-{re.escape(chr(what[1]))}"
        else:
            out += _CATEGORIES[what]
    return f"[{out}]"


def _reach(items: Sequence[tuple]) -> Reach | None:
    total = Reach()
    for op, value in items:
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            _, most, inner = value
            part = _reach(inner)
            if most is sre.MAXREPEAT:
                kind = _kind(inner[0]) if len(inner) == 1 else None
                part = None if kind is None else Reach(0, (kind,))
            elif part is not None:
                part = Reach(part.fixed * most, part.runs * most)
        elif op is sre.SUBPATTERN:
            part = _reach(value[-1])
        elif op is sre.BRANCH:
            options = [_reach(o) for o in value[1]]
            part = None if None in options else Reach(max(o.fixed for o in options), sum((o.runs for o in options), ()))
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            part = _reach(value[1])
        elif op is sre.AT:
            part = Reach(1)
        else:
            part = Reach(1) if _kind((op, value)) is not None else None
        if part is None:
            return None
        total += part
    return total


@lru_cache
def reach_of(pattern: str) -> Reach | None:
    """None for patterns without such a bound: repeated groups, references."""
    return _reach(list(parser.parse(pattern)))


def _marked(files: DataFrame, rules: Sequence[Rule], text: str, range_chars: int, overlap: int) -> DataFrame:
    """KEY, the text, and the rules that its literals admit: those that run by ranges (_ranged) and the others (_whole); _breaks: line feeds of each range.

    Texts that admit no rule are left out. Runs of a kind are looked for only in texts that admit a rule which asks for them.
    """
    prepared, guards, _ = _gated(files, rules, text, KEY)
    admitted = ", ".join(f"CASE WHEN {guard} THEN {i} END" for i, guard in enumerate(guards))
    # The one-row generators keep the optimizer from repeating what they hold in filters and later columns.
    opened = prepared.select(*KEY, text, F.explode_outer(F.array(F.array_compact(F.expr(f"array({admitted})")))).alias("_open")).where("size(_open) > 0")
    reaches = [reach_of(r.pattern) for r in rules]
    askers: dict[tuple[str, bool], list[int]] = {}
    for i, (r, reach) in enumerate(zip(rules, reaches)):
        for kind in dict.fromkeys(reach.runs) if reach is not None else ():
            askers.setdefault((kind, r.ignore_case), []).append(i)
    # Runs of one character need no search: each counts as one at least.
    runs = [
        F.when(
            F.arrays_overlap("_open", F.array(*map(F.lit, some))),
            F.greatest(F.lit(1), F.array_max(F.transform(F.regexp_extract_all(text, F.lit(java_regex(f"{kind}{kind}+", no_case)), F.lit(0)), F.length))),
        )
        for (kind, no_case), some in askers.items()
    ]
    longest = {key: F.get("_runs", F.lit(i)) for i, key in enumerate(askers)}
    bounded = []
    for i, (r, reach) in enumerate(zip(rules, reaches)):
        if reach is not None:
            need = F.lit(reach.fixed)
            for kind in reach.runs:
                need = need + longest[kind, r.ignore_case]
            bounded.append(F.when(F.array_contains("_open", i) & (need + LOOK_AHEAD <= overlap), i))
    measured = opened.select(*KEY, text, "_open", F.explode_outer(F.array(F.array(*runs) if runs else F.lit(None).cast("array<int>"))).alias("_runs"))
    ranged = F.array_compact(F.array(F.lit(None).cast("int"), *bounded))
    breaks = F.transform(_chunks(text, range_chars), _line_feeds)
    return measured.select(*KEY, text, "_open", F.explode_outer(F.array(ranged)).alias("_ranged")).select(
        *KEY, text, "_ranged", F.array_except("_open", "_ranged").alias("_whole"), F.when(F.size("_ranged") > 0, breaks).alias("_breaks"),
    )


def _chunks(text: str, range_chars: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{range_chars}}}"), F.lit(0))


def _line_feeds(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _first(items: Sequence[tuple]) -> tuple[frozenset[str], bool] | None:
    """The characters that a match can begin with, and whether it can be empty; None where they are no short list."""
    firsts: frozenset[str] = frozenset()
    for op, value in items:
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.LITERAL:
            part = frozenset({chr(value)}), False
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            part = _first(value[-1])
        elif op is sre.BRANCH:
            options = [_first(o) for o in value[1]]
            part = None if None in options else (frozenset().union(*(o[0] for o in options)), any(o[1] for o in options))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            part = _first(value[2])
            part = part and (part[0], part[1] or value[0] == 0)
        else:
            part = None
        if part is None:
            return None
        firsts |= part[0]
        if not part[1]:
            return firsts, False
    return firsts, True


@lru_cache
def led_by_first(pattern: str) -> str:
    """The pattern behind a look at the next character, where it is one of several words: most places then try no word at all."""
    parsed = parser.parse(pattern)
    first = _first(list(parsed))
    if first is None or first[1] or len(first[0]) < 2 or parsed.state.flags & ~sre.SRE_FLAG_UNICODE:
        return pattern
    return f"(?=[{''.join(map(re.escape, sorted(first[0])))}]){pattern}"


def _listed(rules: Sequence[Rule], names: str, **changes: object) -> list[Rule]:
    """The rules for texts whose column ``names`` lists them; their own gates and literals have been tried on the whole texts."""
    return [replace(r, pattern=led_by_first(r.pattern), gate=lambda i=i: F.array_contains(names, i), **changes) for i, r in enumerate(rules)]


def ranged_occurrences(files: DataFrame, rules: Sequence[Rule], text: str = "content", range_chars: int = RANGE_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """repo_id, path, rule, start, line_no, matched, before, after: what ``occurrences`` finds, texts above ``range_chars`` by ranges.

    (repo_id, path) must name a file once. Ranges and their matches are tables in the shared folder.
    """
    if range_chars < 2 * overlap or overlap <= LOOK_BEHIND + LOOK_AHEAD:
        raise ValueError("a range must hold two overlaps, an overlap more than the context of a match")
    columns = [*KEY, "rule", "start", "line_no", "matched", "before", "after"]
    spark, folder = files.sparkSession, run_folder(files.sparkSession, "ranges")
    long = F.coalesce(F.length(text) > range_chars, F.lit(False))
    small = occurrences(files.where(~long), rules, text).select(columns)
    _marked(files.where(long), rules, text, range_chars, overlap).write.parquet(f"{folder}/files")
    large = spark.read.parquet(f"{folder}/files")
    if not large.limit(1).count():
        return small
    anyway = {"needles": (), "also": ()}
    whole = occurrences(large.where("size(_whole) > 0"), _listed(rules, "_whole", **anyway), text).select(columns)

    by_range = large.where("size(_ranged) > 0")
    cut = by_range.select(*KEY, "_ranged", _chunks(text, range_chars).alias("_chunks"))
    parts = F.transform(
        "_chunks",
        lambda c, i: F.struct(
            i.alias("range"),
            F.coalesce(F.right(F.get("_chunks", i - 1), F.lit(2 * overlap)), F.lit("")).alias("behind"), c.alias("own"),
            F.coalesce(F.left(F.get("_chunks", i + 1), F.lit(overlap)), F.lit("")).alias("ahead"),
        ),
    )
    pieces = cut.select(*KEY, "_ranged", F.explode(parts).alias("p")).select(
        *KEY, "_ranged", "p.range", F.concat("p.behind", "p.own", "p.ahead").alias(text), F.length("p.behind").alias("_behind"), _line_feeds(F.col("p.behind")).alias("_back"),
    )
    # One row a range; dealt by its number, so that no task gets all ranges of a text.
    pieces = pieces.repartition(*KEY, "range")
    found = occurrences(pieces, _listed(rules, "_ranged"), text, [*KEY, "range", "_behind", "_back"])
    at = F.col("range") * range_chars - F.col("_behind") + F.col("start")
    found = found.select(*KEY, "rule", "range", at.cast("int").alias("start"), (F.col("line_no") - F.col("_back")).alias("line_no"), "matched", "before", "after")
    # What a range owns, and what it sees in the last `overlap` characters before its own.
    side = F.floor(F.col("start") / range_chars)
    found = found.where((side == F.col("range")) | ((side + 1 == F.col("range")) & (F.col("range") * range_chars - F.col("start") <= overlap)))
    earlier = Window.partitionBy(*KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lines = by_range.select(*KEY, F.posexplode("_breaks").alias("range", "_lines"))
    lines = lines.select(*KEY, "range", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    # Matches are joined with the lines before their range; the texts themselves are dealt once.
    found = found.join(lines, [*KEY, "range"]).withColumn("line_no", (F.col("_before") + F.col("line_no")).cast("int")).drop("_before")
    found.write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    owned = found.where(F.floor(F.col("start") / range_chars) == F.col("range"))
    # Matches in the last `overlap` characters before a border, as both sides see them.
    border = (F.floor(F.col("start") / range_chars) + 1) * range_chars
    side = F.floor(F.col("start") / range_chars).alias("side")
    near = found.where((border - F.col("start") <= overlap) & F.col("range").isin(F.floor(F.col("start") / range_chars), F.floor(F.col("start") / range_chars) + 1))
    ends = by_range.select(*KEY, (F.size("_breaks") - 1).alias("_last"))
    seen = near.groupBy(*KEY, "rule", side, "start", F.length("matched").alias("n")).agg(F.count("*").alias("sides"))
    astray = seen.where("sides < 2").join(ends, KEY).where("side < _last").select(*KEY, "rule").distinct()
    astray.write.parquet(f"{folder}/astray")
    astray = spark.read.parquet(f"{folder}/astray")
    if not astray.limit(1).count():
        return small.unionByName(whole).unionByName(owned.select(columns))
    again = large.drop("_ranged").join(astray.groupBy(*KEY).agg(F.collect_set("rule").alias("_ranged")), KEY)
    rest = occurrences(again, _listed(rules, "_ranged", **anyway), text).select(columns)
    return small.unionByName(whole).unionByName(owned.join(astray, [*KEY, "rule"], "left_anti").select(columns)).unionByName(rest)


def match_content_by_ranges(files: DataFrame, rules: Sequence[Rule], text: str = "content", range_chars: int = RANGE_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``match_content`` in which no task grows with the largest text."""
    return findings_of(ranged_occurrences(files, rules, text, range_chars, overlap), rules)
