"""Pipeline steps of several lines: a block ``run: |`` is judged as the one command it is.

Lines are cut into blocks by indentation. A block starts at a ``run:`` key that ends in a block sign, and lasts while lines are
blank or stand deeper than the key. Its lines are joined as a shell runs them, one after the other; a backslash joins without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palisade.functions.text import explode_lines, java_regex, strip, truncate
from palisade.rules import workflows
from palisade.rules.base import LineRule
from palisade.schema import as_findings

HEAD = r"^(\s*(?:-\s+)?)run:\s*[|>][0-9+-]*\s*$"
#: Rules that look at a command; those on env and pinned actions do not.
RULES = [r for r in workflows.LINE_RULES if r.rule_id in ("W5", "W6", "W7", "W8", "W9", "W10", "W12")]


def run_blocks(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no (of the key), n_lines, command: the blocks of pipeline files, empty ones left out."""
    gated = files.where(workflows.GATE() & F.col("content").rlike(r"run:\s*[|>]"))
    lines = explode_lines(gated).withColumns(
        {
            "head": F.col("line").rlike(HEAD),
            "text": strip(F.col("line")),
            "indent": F.length("line") - F.length(F.ltrim("line")),
        }
    )
    key_indent = F.length(F.regexp_extract("line", HEAD, 1))
    so_far = Window.partitionBy("repo_id", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.last(F.when(F.col("head"), F.struct("line_no", key_indent.alias("indent"))), ignorenulls=True).over(so_far)
    of_block = lines.withColumn("block", heads).where("block is not null and not head")
    in_block = Window.partitionBy("repo_id", "path", "block.line_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max((F.col("text") != "") & (F.col("indent") <= F.col("block.indent"))).over(in_block)
    body = of_block.withColumn("ended", ended).where("not ended and text <> ''")
    blocks = body.groupBy("repo_id", "path", F.col("block.line_no").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    joined = F.regexp_replace(F.array_join("l.text", " && "), r"\\ && ", "")
    return blocks.select("repo_id", "path", "line_no", F.size("l").alias("n_lines"), F.concat(F.lit("run: "), joined).alias("command"))


def detect_run_blocks(files: DataFrame, rules: list[LineRule] | None = None) -> DataFrame:
    """A finding for each block and rule that its command meets."""
    blocks = run_blocks(files)
    parts = None
    for r in RULES if rules is None else rules:
        found = blocks.where(F.col("command").rlike(java_regex(r.pattern, r.ignore_case))).select(
            "repo_id", "path", F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
            F.lit(r.category).alias("category"), F.lit(r.title).alias("title"),
            F.concat(F.lit(r.description), truncate(F.col("command"), r.cut)).alias("description"), "line_no", F.col("command").alias("snippet"),
        )
        parts = found if parts is None else parts.unionByName(found)
    return as_findings(parts, "workflow")
