"""Renames, look-alikes, similar names, steps of several lines, pages, stored policies, huge texts."""

import datetime
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palisade.operators import confusables, history, incremental, policy, ranges, run_blocks, similar_names
from palisade.operators.dependencies import MIN_RATIO
from palisade.operators.joins import numbered
from palisade.operators.matching import match_content, occurrences
from palisade.plans.seeded import SEEDS
from palisade.rules.base import Rule, built_in_rules

SNAPSHOT = "repo_id string, path string, size long, sha256 string"


def test_numbers_within_keys_are_taken_over_ranges(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", j) for i in range(50) for j in range(i % 4)] + [(None, 7), (None, 8)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = numbered(spark.createDataFrame(rows, "k string, o long"), ["k"], ["o"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    places = Counter()
    want = []
    for k, o in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        places[k] += 1
        want.append((k or "", o, places[k]))
    assert sorted((r.k or "", r.o, r.n) for r in got) == want


def test_renames_and_copies(spark):
    old = [("r", f"a{i}", 1, "same") for i in range(6)] + [("r", "keep", 1, "k"), ("r", "edit", 1, "e1"), ("r", "gone", 1, "g"), ("s", "x", 1, "same"), ("r", "no", 1, None)]
    new = [("r", f"b{i}", 1, "same") for i in range(4)] + [("r", "a5", 1, "same"), ("r", "keep", 1, "k"), ("r", "copy", 1, "k"), ("r", "edit", 1, "e2"), ("r", "fresh", 1, "f"), ("r", "nope", 1, None)]
    got = sorted((r.repo_id, r.path, r.change, r.old_path) for r in incremental.diff_with_renames(spark.createDataFrame(old, SNAPSHOT), spark.createDataFrame(new, SNAPSHOT)).collect())
    assert got == sorted(
        [("r", f"b{i}", "renamed", f"a{i}") for i in range(4)]
        + [("r", "a4", "deleted", None), ("r", "copy", "copied", "keep"), ("r", "edit", "modified", None), ("r", "fresh", "added", None), ("r", "gone", "deleted", None)]
        + [("r", "no", "deleted", None), ("r", "nope", "added", None), ("s", "x", "deleted", None)],
        key=lambda x: (x[0], x[1], x[2], x[3] or ""),
    )


def test_words_with_several_replaced_letters(spark, as_files):
    files = as_files([
        ("a.txt", "ok eval\n_еvаl hеlо rеquirе еvаl еvаl"), ("b.txt", "арасhе plain"), ("c.bin", "еval"), ("d.txt", ""),
    ])
    own = spark.createDataFrame([("apache",), ("eval",), ("eval",), (None,), ("еval",)], "name string")
    words = lambda names: sorted((r.path, r.line_no, r.word, r.name) for r in confusables.confusable_words(files, names).collect())
    assert words(None) == [("a.txt", 2, "rеquirе", "require"), ("a.txt", 2, "еvаl", "eval"), ("a.txt", 2, "еvаl", "eval")]
    assert ("b.txt", 1, "арасhе", "apache") in words(own) and ("a.txt", 2, "еvаl", "еval") in words(own)
    found = confusables.confusable_findings(files).collect()
    assert {(r.path, r.line_no, r.title) for r in found} == {("a.txt", 2, "Look-alike letters imitate 'require'"), ("a.txt", 2, "Look-alike letters imitate 'eval'")}
    assert len(found) == 2 and all("еvаl" in r.snippet for r in found)


def test_similar_names_equal_the_exact_ratio_of_all_pairs(spark):
    rng = random.Random(5)
    popular = ["".join(rng.choice("abcdeilnorst-") for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["", "a", "été"]
    names = []
    for _ in range(600):
        word = list(rng.choice(popular))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "e", "tt", "1"])
        names.append("".join(word))
    frame = lambda words, name: spark.createDataFrame([(w,) for w in [*words, None, *words[:5]]], f"{name} string")
    got = {(r["name"], r.popular): r.ratio for r in similar_names.similar_names(frame(names, "name"), frame(popular, "popular")).collect()}
    pairs = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(names) for b in set(popular)}
    assert got == {k: v for k, v in pairs.items() if MIN_RATIO <= v < 1.0 and all(k)} and len(got) > 200
    bounds = similar_names.bound_pairs(frame(names, "name"), frame(popular, "popular")).collect()
    assert len(bounds) == len({(r["name"], r.popular) for r in bounds}) < len(pairs) / 4
    assert similar_names.similar_names(frame([], "name").where("name is not null"), frame(popular, "popular")).count() == 0


def test_steps_of_several_lines(as_files):
    text = """jobs:
  a:
    steps:
      - run: |
          curl -O https://x.example/a.sh

          bash a.sh
      - name: x
        run: >-
          echo fine
        shell: sh
      - run: |
          chmod \\
            +x a
      - run: curl -O x && bash y
      - run: |
      - run: |2
            wget x | \\
              sh
env: 1
"""
    files = as_files([(".github/workflows/a.yml", text), ("docs/a.yml", text), (".github/workflows/b.yml", ""), (".github/workflows/c.yml", "run: |\n")])
    blocks = {r.line_no: (r.n_lines, r.command) for r in run_blocks.run_blocks(files).collect()}
    assert blocks == {
        4: (2, "run: curl -O https://x.example/a.sh && bash a.sh"), 9: (1, "run: echo fine"), 12: (2, "run: chmod +x a"), 17: (2, "run: wget x | sh"),
    }
    assert {(r.rule_id, r.line_no) for r in run_blocks.detect_run_blocks(files).collect()} == {("W6", 4), ("W9", 12), ("W5", 17)}


def test_a_page_reads_the_newest_dates_only(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"s{d}-{i}", start + datetime.timedelta(days=d, hours=i % 5), "high" if i % 3 else "low") for d in range(40) for i in range(6)]
    scans = spark.createDataFrame(rows, "scan_id string, scan_time timestamp, max_severity string").withColumn("scan_date", F.to_date("scan_time"))
    history.append_scans(scans, str(tmp_path / "scans"))
    tags = spark.createDataFrame([(r[0], "t") for r in rows[::17]], "scan_id string, tag string")
    ids = lambda df: [r.scan_id for r in df.collect()]
    for limit, offset, tag, severity in ((5, 0, None, None), (7, 20, None, "low"), (50, 230, None, None), (3, 2, "t", None), (9, 500, None, None)):
        page = history.page_of_scans(spark, str(tmp_path / "scans"), limit, offset, tag, tags, severity)
        assert ids(page) == ids(history.list_scans(scans, limit, offset, tag, tags, severity))
    plan = history.page_of_scans(spark, str(tmp_path / "scans"), 5, 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan and "2024-02-09" in plan
    with pytest.raises(ValueError):
        history.page_of_scans(spark, str(tmp_path / "none"))


def test_stored_policies_are_judged_like_single_ones(spark):
    import json

    bodies = [
        '{"severity_threshold":"high"}', "{}", '{"severity_threshold":"odd"}', '{"severity_threshold":""}', '{"block_categories":"x"}', '{"block_categories":["x"],"allow_paths":[]}',
        '{"allow_paths":[1]}', '{"severity_threshold":null,"allow_paths":null}', '{"severity_threshold":3}', "[1]", "7", "not json", None, '{"block_categories":{"a":1},"severity_threshold":"x"}',
    ]
    rows = policy.policy_errors(spark.createDataFrame(list(enumerate(bodies)), "policy_id int, body string")).collect()
    faulty = {r.policy_id for r in rows}

    def sound(body):
        try:
            values = json.loads(body)
            lists = [values.get(n) for n in ("block_categories", "allow_paths")]
            policy.policy_from_row(values)
            return all(x is None or all(isinstance(y, str) for y in x) for x in lists)
        except (TypeError, ValueError, AttributeError):
            return False

    assert faulty == {i for i, body in enumerate(bodies) if not sound(body)}
    assert sorted(r.reason for r in rows if r.policy_id == 13) == ["block_categories is no list of texts", "severity_threshold is unknown"]


def test_ranges_find_what_the_whole_text_holds(spark, as_files):
    rules = [r for r in built_in_rules() if isinstance(r, Rule)]
    rng = random.Random(8)
    snippets = [s.snippet for s in SEEDS if s.layout != "json"]
    text = ""
    while len(text) < 60_000:
        text += rng.choice(snippets) + rng.choice([" ", "\n", "\n\n", " x " * rng.randrange(200)])
    files = as_files([("big.txt", text), ("setup.py", text[:9000]), ("small.js", text[:700]), ("gap.js", "eval" + " " * 3000 + "('1')" + "\n" * 2000 + text[:500]), ("e.txt", "")])
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(match_content(files, rules))
    assert len(whole) > 300 and key(ranges.match_content_by_ranges(files, rules, range_chars=1100, overlap=500)) == whole
    columns = ["path", "rule", "start", "line_no", "matched", "before", "after"]
    assert key(ranges.ranged_occurrences(files, rules, range_chars=900, overlap=300).select(columns)) == key(occurrences(files, rules).select(columns))


def test_ranges_that_do_not_agree_are_matched_whole(spark, as_files):
    """'ab.' over a long run of equal letters steps by three from the text's start, which no range can know."""
    rule = Rule(rule_id="Z", analyzer="z", pattern="a.a|xyz", severity="low", category="z", title="z")
    files = as_files([("a.txt", "xy" + "a" * 2001 + "xyz" * 300), ("b.txt", "xyz " * 500)])
    columns = ["path", "start", "line_no", "matched"]
    got = ranges.ranged_occurrences(files, [rule], range_chars=200, overlap=80).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, occurrences(files, [rule]).select(columns).collect()))
    with pytest.raises(ValueError):
        ranges.ranged_occurrences(files, [rule], range_chars=100, overlap=80)


def test_patterns_without_a_bound_are_known():
    assert ranges.reach_of("(?:ab)*c") is None and ranges.reach_of(r"(a)\1") is None
    assert ranges.reach_of(r"ab{2,3}c|x\s*y") == ranges.Reach(5, (r"[\s]",))
