"""Text primitives as native column expressions.

Two position systems exist and both are needed: *line* operators break text where
``str.splitlines`` does, *occurrence* operators count only line feeds before a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Line boundaries and white space as Python's text type defines them.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java needs `d` so that `.` and `$` stop at line feeds only, and `U` so that \w \s \d are Unicode classes.
JAVA_FLAGS = "(?dU)"
JAVA_FLAGS_NO_CASE = "(?dUiu)"

# Longest context that any rule shows before / after a match.
LOOK_BEHIND = 30
LOOK_AHEAD = 40


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return (JAVA_FLAGS_NO_CASE if ignore_case else JAVA_FLAGS) + pattern


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def split_lines(text: Column) -> Column:
    pieces = F.split(text, LINE_BREAK, -1)
    surplus = F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    return F.slice(pieces, F.lit(1), F.size(pieces) - surplus)


def explode_lines(df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """One row per line with its 1-based number; a narrow flat-map, nothing is shuffled.

    The outer form of the generator is deliberate: the inner form makes the optimizer add a
    ``size(split(...)) > 0`` filter, which would split every text twice.
    """
    return df.select(*keep, F.posexplode_outer(split_lines(F.col(text))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    ).where("line is not null")


def context(line: Column, target: Column, radius: int = 40) -> Column:
    """Window around the first occurrence of ``target``; the whole line when it is absent."""
    at = F.position(target, line) - 1
    start = F.greatest(at - radius, F.lit(0))
    window = F.substring(line, start + 1, at + radius - start)
    return truncate(strip(F.when(at < 0, line).otherwise(window)), 150)


def is_meaningful(text: Column, min_len: int = 5) -> Column:
    """Decoded bytes that read like text: long enough and at least 70 % printable ASCII."""
    length = F.length(text)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7e]", ""))
    verdict = (length >= min_len) & (printable / length >= 0.7)
    if min_len > 5:
        return verdict
    one_word = (length > 50) & text.rlike(r"^\p{L}+$")
    return verdict & ~one_word


def shannon_entropy(text: Column) -> Column:
    """Bits per character. Meant for single lines that already passed a cheap shape test."""
    total = F.length(text)
    # Sorted, equal characters stand together: a run each, whatever their number.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    shares = F.transform(runs, lambda run: F.length(run) / total)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, share: acc - share * F.log2(share))
    return F.when(total > 0, F.round(bits, 9)).otherwise(0.0)


def fold_case(text: Column) -> Column:
    """Lower case in which the non-ASCII letters that regex folding equates with i and s are ASCII too."""
    odd = F.lit(False)
    for letter in ("\u0130", "\u0131", "\u017f"):
        odd = odd | F.contains(text, F.lit(letter))
    return F.lower(F.when(odd, F.translate(text, "\u0130\u0131\u017f", "iis")).otherwise(text))


# Matches handled together; array functions copy their input, so work per match must not see the whole array.
MATCH_BLOCK = 64


def _running_before(values: str) -> str:
    """Exclusive prefix sums of a short int array, as SQL."""
    return (
        f"aggregate({values}, named_struct('out', cast(array() AS array<int>), 'total', 0), "
        "(acc, x) -> named_struct('out', concat(acc.out, array(acc.total)), 'total', acc.total + x), acc -> acc.out)"
    )


def locate_matches(df: DataFrame, keep: list[str], gaps: str = "gaps", hits: str = "hits") -> DataFrame:
    """Turn the pieces of one text (``split``) and its matches (``regexp_extract_all``) into one row per match.

    Yields occurrence, start (0-based), line_no, matched, and up to LOOK_BEHIND / LOOK_AHEAD characters around it.
    Matches are cut into blocks that carry their own offset and border context, so a file with
    hundreds of thousands of matches costs about as much per match as one with ten.
    """
    size, behind, ahead = MATCH_BLOCK, LOOK_BEHIND, LOOK_AHEAD
    newlines = "length({0}) - length(replace({0}, '\n', ''))"
    pieces = df.selectExpr(
        *keep,
        f"{gaps} AS _g",
        f"{hits} AS _h",
        f"zip_with({gaps}, concat({hits}, array('')), (g, h) -> concat(g, h)) AS _gh",
    ).selectExpr(
        *keep,
        "_g",
        "_h",
        "transform(_gh, x -> length(x)) AS _chars",
        f"transform(_gh, x -> {newlines.format('x')}) AS _breaks",
        f"transform(_gh, x -> left(x, {ahead})) AS _heads",
        f"transform(_gh, x -> right(x, {behind})) AS _tails",
    )
    block_ids = f"sequence(0, cast(floor(greatest(size(_h) - 1, 0) / {size}) AS int))"
    first = f"greatest(b * {size} - {behind}, 0)"
    before = f"array_join(slice(_tails, {first} + 1, b * {size} - {first}), '')"
    after = f"array_join(slice(_heads, (b + 1) * {size} + 1, {ahead} + 1), '')"

    def cut(name: str) -> str:
        return f"slice({name}, b * {size} + 1, {size})"

    def total(name: str) -> str:
        return f"aggregate({cut(name)}, 0, (acc, x) -> acc + x)"

    blocks = pieces.selectExpr(
        *keep,
        _running_before(f"transform({block_ids}, b -> {total('_chars')})") + " AS _chars_before",
        _running_before(f"transform({block_ids}, b -> {total('_breaks')})") + " AS _breaks_before",
        f"transform({block_ids}, b -> named_struct('_b', b, '_g', {cut('_g')}, '_h', {cut('_h')}, "
        f"'_chars', {cut('_chars')}, '_breaks', {cut('_breaks')}, "
        f"'_heads', concat({cut('_heads')}, array(left({after}, {ahead}))), "
        f"'_tails', concat(array(right({before}, {behind})), {cut('_tails')}))) AS _blocks",
    ).selectExpr(*keep, "_chars_before", "_breaks_before", "inline_outer(_blocks)").selectExpr(
        *keep,
        "_b",
        "_g",
        "_h",
        "_heads",
        "_tails",
        "get(_chars_before, _b) AS _chars_before",
        "get(_breaks_before, _b) AS _breaks_before",
        _running_before("_chars") + " AS _chars",
        _running_before("_breaks") + " AS _breaks",
    )
    # Most pieces are longer than the context; only short ones need their neighbours.
    near = f"greatest(i + 1 - {behind}, 0)"
    earlier = f"CASE WHEN length(get(_g, i)) >= {behind} THEN '' ELSE array_join(slice(_tails, {near} + 1, i + 1 - {near}), '') END"
    later = f"CASE WHEN length(get(_heads, i + 1)) >= {ahead} THEN get(_heads, i + 1) ELSE array_join(slice(_heads, i + 2, {ahead}), '') END"
    return blocks.selectExpr(
        *keep,
        "inline_outer(transform(sequence(0, greatest(size(_h) - 1, 0)), i -> named_struct("
        f"'occurrence', _b * {size} + i, "
        "'start', _chars_before + get(_chars, i) + length(get(_g, i)), "
        f"'line_no', _breaks_before + get(_breaks, i) + {newlines.format('get(_g, i)')} + 1, "
        "'matched', get(_h, i), "
        f"'before', right(concat({earlier}, right(get(_g, i), {behind})), {behind}), "
        f"'after', left({later}, {ahead}))))",
    )


def find_all(df: DataFrame, pattern: str, text: str = "content", keep: tuple[str, ...] = ("repo_id", "path"),
             ignore_case: bool = False) -> DataFrame:
    """Every match of one pattern with its position: the ``finditer`` shape."""
    rx = java_regex(pattern, ignore_case)
    return locate_matches(
        df.where(F.col(text).rlike(rx)).select(
            *keep,
            F.split(text, rx, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("hits"),
        ),
        list(keep),
    )
