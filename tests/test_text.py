"""Text primitives against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from palisade.functions import text as X
from palisade.rules.behavior import RULES


def _random_texts(pieces, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def _by_path(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r.path, []).append(value(r))
    return {k: sorted(v) for k, v in out.items()}


def test_lines_break_where_splitlines_does(as_files):
    pieces = ["a", "b ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\u00e9"]
    texts = _random_texts(pieces, 400, 25, 1) + ["", "\n", "a\n", "\n\n"]
    got = _by_path(X.explode_lines(as_files([(str(i), t) for i, t in enumerate(texts)])).collect(), lambda r: (r.line_no, r.line))
    for i, t in enumerate(texts):
        assert got.get(str(i), []) == list(enumerate(t.splitlines(), 1))


def test_find_all_equals_finditer_with_context(as_files):
    pieces = ["a", "\n", "\u00e9", "at ", "at\t", "xx", " ", "\r\n", "\U0001f600"]
    texts = _random_texts(pieces, 150, 60, 2) + _random_texts(pieces, 4, 3000, 3)
    rows = X.find_all(as_files([(str(i), t) for i, t in enumerate(texts)]), r"at\s+").collect()
    got = _by_path(rows, lambda r: (r.occurrence, r.start, r.line_no, r.matched, r.before, r.after))
    for i, t in enumerate(texts):
        want = [
            (k, m.start(), t[: m.start()].count("\n") + 1, m.group(0), t[max(0, m.start() - 30): m.start()], t[m.end(): m.end() + 40])
            for k, m in enumerate(re.finditer(r"at\s+", t))
        ]
        assert got.get(str(i), []) == want


def test_more_matches_than_a_block(as_files):
    t = "at x\n" * (3 * X.MATCH_BLOCK + 7)
    rows = X.find_all(as_files([("p", t)]), r"at\s+").orderBy("occurrence").collect()
    assert [(r.start, r.line_no) for r in rows] == [(5 * i, i + 1) for i in range(3 * X.MATCH_BLOCK + 7)]


def test_rules_match_as_python_does_on_accented_text(as_files):
    """All behaviour patterns, compared on text with accents, escapes and odd case."""
    words = ["Function('x')", "fetch (\u00e9 http", "\u00e9at ", "reg\u00a0add", "SOCKET", "\u017fend", "ping x", "os.system", "\n", " ", "chmod +", "ftp a@b", "\u0130", "p\u0130ng z", "eval('a')"]
    texts = _random_texts(words, 60, 12, 4)
    files = as_files([(f"{i}.py", t) for i, t in enumerate(texts)])
    from palisade.operators.families import detect_behavior

    got = Counter((r.path, r.rule_id, r.line_no) for r in detect_behavior(files).collect())
    want = Counter()
    for i, t in enumerate(texts):
        for rule in RULES:
            for m in re.finditer(rule.pattern, t, re.IGNORECASE):
                want[(f"{i}.py", rule.rule_id, t[: m.start()].count("\n") + 1)] += 1
    assert got == want


def test_needles_are_implied_by_the_pattern(as_files):
    """A needle shortcut must not lose matches: rules with and without it agree on the seeded snippets."""
    from dataclasses import replace

    from palisade.operators.matching import match_content
    from palisade.plans.seeded import SEEDS
    from palisade.rules.base import Rule, everything, select_rules

    rules = [replace(r, gate=everything) for r in select_rules() if isinstance(r, Rule)]
    files = as_files([(f"{i}/{s.path}", s.snippet) for i, s in enumerate(SEEDS)])
    count = lambda rs: Counter(tuple(r) for r in match_content(files, rs).select("path", "rule_id", "line_no").collect())
    with_needles = count(rules)
    assert with_needles and with_needles == count([replace(r, needles=()) for r in rules])


def test_truncate_context_strip_entropy_meaningful(spark):
    rows = [
        ("x" * 200, "x"), ("  needle in " + "h" * 90, "needle"), ("abc", "zz"), ("\u2003padded\t", "a"), ("", "q"),
        ("abcdefghijklmnopqrstuvwxyz" * 2 + "abc", "m"), ("a\x00b\x00c\x00d\x00", "a"),
    ]

    def py_context(line, target, radius=40):
        cut = lambda s, n: s[:n] + "..." if len(s) > n else s
        i = line.find(target)
        if i == -1:
            return cut(line.strip(), 150)
        return cut(line[max(0, i - radius): min(len(line), i + radius)].strip(), 150)

    def py_entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0

    def py_meaningful(t):
        if len(t) < 5 or sum(" " <= c <= "~" for c in t) / len(t) < 0.7:
            return False
        return not (" " not in t and len(t) > 50 and t.isalpha())

    t, k = F.col("t"), F.col("k")
    got = spark.createDataFrame(rows, "t string, k string").select(
        "t", "k", X.truncate(t, 10).alias("cut"), X.context(t, k).alias("ctx"), X.strip(t).alias("s"),
        X.shannon_entropy(t).alias("e"), X.is_meaningful(t).alias("m"),
    ).collect()
    for r in got:
        assert r.cut == (r.t[:10] + "..." if len(r.t) > 10 else r.t)
        assert r.ctx == py_context(r.t, r.k)
        assert r.s == r.t.strip()
        assert abs(r.e - py_entropy(r.t)) < 1e-6
        assert r.m == py_meaningful(r.t)
