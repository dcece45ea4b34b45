"""Rule rows and the catalog that holds them.

A rule is data: a pattern literal plus what a match means. Patterns always reach Spark as literals, so each
is compiled once per task and never per row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields, is_dataclass
from functools import lru_cache
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Gate = Callable[[], Column]


def text_files() -> Column:
    """Text files of any size."""
    return F.col("is_text")


@lru_cache
def limited(gate: Gate, below: int) -> Gate:
    """The gate for files of fewer than ``below`` bytes."""
    return lambda: gate() & (F.col("size") < below)


@lru_cache
def named(*names: str) -> Gate:
    """File name equals one of ``names``, ignoring case."""
    return lambda: F.lower(F.substring_index("path", "/", -1)).isin(*names)


def everything() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Rule:
    """One finding per occurrence of ``pattern`` in the whole text.

    ``needles`` are lower-case literals of which every match holds at least one; a file without any of them
    skips the regular expression. Empty means no such shortcut. ``also`` are more literals of the same kind: every match holds one of these too.
    ``cut`` > 0 appends the match, cut at that length, to ``description`` followed by ``tail``.
    ``calls_url`` takes the address inside the match as the value of the finding and drops trusted hosts.
    ``window`` is (characters before, characters after, cap) of the snippet, or None for no snippet.
    """

    rule_id: str
    analyzer: str
    pattern: str
    severity: str
    category: str
    title: str
    confidence: str = "medium"
    ignore_case: bool = False
    needles: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    description: str = ""
    cut: int = 0
    tail: str = ""
    window: tuple[int, int, int] | None = None
    calls_url: bool = False
    with_line: bool = True
    gate: Gate = everything
    slow: bool = False
    priority: int = 50


@dataclass(frozen=True)
class LineRule:
    """One finding per line on which ``pattern`` is found.

    ``stripped`` matches the trimmed line. ``describe`` names the description shape: a prefix, and the length at
    which the trimmed line is cut; "{line}" in the prefix stands for the line number.
    """

    rule_id: str
    analyzer: str
    pattern: str
    severity: str
    category: str
    title: str
    confidence: str = "medium"
    ignore_case: bool = False
    stripped: bool = True
    description: str = ""
    cut: int = 200
    snippet_cut: int = 0
    skip_comments: bool = False
    gate: Gate = everything
    slow: bool = False
    priority: int = 50


_REGISTERED: list[Rule | LineRule] = []


def built_in_rules() -> list[Rule | LineRule]:
    from palisade.rules import behavior, builds, docker, network, patterns, secrets, workflows

    return [
        *patterns.RULES,
        *secrets.RULES,
        *docker.LINE_RULES,
        *builds.PYTHON_LINE_RULES,
        *builds.PYPROJECT_RULES,
        *builds.BUILD_RS_RULES,
        *workflows.LINE_RULES,
        *workflows.RULES,
        *network.RULES,
        *behavior.RULES,
    ]


def register_rules(rules: Iterable[Rule | LineRule]) -> None:
    """Add user-defined rules; they run in the same pass as the built-in ones."""
    known = {r.rule_id for r in built_in_rules()} | {r.rule_id for r in _REGISTERED}
    for rule in rules:
        if rule.rule_id in known:
            raise ValueError(f"rule {rule.rule_id!r} exists already")
        known.add(rule.rule_id)
        _REGISTERED.append(rule)


def unregister_rules(rule_ids: Iterable[str]) -> None:
    drop = set(rule_ids)
    _REGISTERED[:] = [r for r in _REGISTERED if r.rule_id not in drop]


def registered_rules() -> list[Rule | LineRule]:
    return list(_REGISTERED)


def select_rules(skip: Iterable[str] = (), quick: bool = False,
                 rules: Iterable[Rule | LineRule] | None = None) -> list[Rule | LineRule]:
    """Rules to run, by priority; ``quick`` leaves out the slow families."""
    skipped = {name.lower() for name in skip}
    pool = list(rules) if rules is not None else [*built_in_rules(), *_REGISTERED]
    kept = [r for r in pool if r.analyzer.lower() not in skipped and not (quick and r.slow)]
    return sorted(kept, key=lambda r: r.priority)


DETECTOR_MODULES = ("svg", "scripts", "dependencies", "unicode_tricks", "urls", "entropy", "mime", "wasm", "families", "advice")


def _print_of(value: object) -> str:
    """A text that changes with a table, a rule or a gate, and is the same in every process."""
    if is_dataclass(value) and not isinstance(value, type):
        return type(value).__name__ + "(" + ",".join(f"{f.name}={_print_of(getattr(value, f.name))}" for f in fields(value)) + ")"
    if isinstance(value, dict):
        return "{" + ",".join(sorted(f"{_print_of(k)}:{_print_of(v)}" for k, v in value.items())) + "}"
    if isinstance(value, (set, frozenset)):
        return "{" + ",".join(sorted(map(_print_of, value))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_print_of, value)) + "]"
    code = getattr(value, "__code__", None)
    if code is not None:
        inner = [c.cell_contents for c in value.__closure__ or ()]
        constants = [c for c in code.co_consts if not hasattr(c, "co_code")]
        nested = [c.co_code.hex() for c in code.co_consts if hasattr(c, "co_code")]
        return f"{value.__qualname__}:{code.co_code.hex()}:{nested}:{code.co_names}:{_print_of(constants)}:{_print_of(inner)}"
    return re.sub(r" at 0x[0-9a-f]+", "", repr(value))


def rules_version(rules: Iterable[Rule | LineRule] | None = None, detectors: dict[str, object] | None = None) -> str:
    """Changes whenever a rule, its gate, a table of any detector family or a registered detector changes.

    Results of files are reused only under the version they were made with.
    """
    digest = hashlib.sha256()
    for rule in sorted(rules if rules is not None else select_rules(), key=lambda r: r.rule_id):
        digest.update(_print_of(rule).encode())
    for name in DETECTOR_MODULES:
        module = import_module(f"palisade.operators.{name}")
        for key, value in sorted(vars(module).items()):
            if key.isupper() or getattr(value, "__module__", "") == module.__name__:
                digest.update(f"{name}.{key}={_print_of(value)}".encode())
    for name, detector in sorted((detectors or {}).items()):
        digest.update(f"{name}={_print_of(detector)}".encode())
    return digest.hexdigest()[:16]


def catalog_frame(spark: SparkSession, rules: Iterable[Rule | LineRule] | None = None) -> DataFrame:
    """The catalog as a table (a few hundred rows at most)."""
    rows = [
        (r.rule_id, r.analyzer, "line" if isinstance(r, LineRule) else "content", r.pattern, r.severity,
         r.confidence, r.category, r.title, r.ignore_case, r.slow, r.priority)
        for r in (rules if rules is not None else select_rules())
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, analyzer string, scope string, pattern string, severity string, confidence string, "
        "category string, title string, ignore_case boolean, slow boolean, priority int",
    )
