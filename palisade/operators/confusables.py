"""Look-alike words by their skeleton: what a word shows once its look-alike letters are read as those they imitate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import context, find_all, split_lines
from palisade.operators.joins import salted_join
from palisade.operators.unicode_tricks import GATE, KEYWORDS, LOOK_ALIKES
from palisade.schema import as_findings

IMITATIONS, IMITATED = "".join(c for c, _ in LOOK_ALIKES), "".join(c for _, c in LOOK_ALIKES)
LETTER = r"[\p{L}\p{N}_]"
#: A word with at least one imitation.
WORD = f"{LETTER}*[{IMITATIONS}]{LETTER}*"


def skeleton(text: Column) -> Column:
    return F.translate(text, IMITATIONS, IMITATED)


def confusable_words(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """repo_id, path, line_no, word, name: every word whose skeleton is one of ``names`` (name) and that is not that name itself.

    Any number of letters may be replaced. Words meet names in an equi-join on the skeleton, which leaves out nothing and compares
    no word with more than its own name; the list may be as large as the texts. Without a list the guarded keywords stand in.
    """
    spark = files.sparkSession
    if names is None:
        names = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in KEYWORDS])).alias("name"))
    words = find_all(files.where(GATE()), WORD).select("repo_id", "path", "line_no", "start", F.col("matched").alias("word"), skeleton(F.col("matched")).alias("skeleton"))
    known = names.where("name is not null").select("name", skeleton(F.col("name")).alias("skeleton")).distinct()
    return salted_join(words, known, ["skeleton"]).where("word <> name").select("repo_id", "path", "line_no", "start", "word", "name")


def confusable_findings(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A finding for each line and word that imitates a name with any number of letters."""
    found = confusable_words(files, names).groupBy("repo_id", "path", "line_no", "word", "name").agg(F.min("start").alias("start"))
    lines = files.select("repo_id", "path", split_lines(F.col("content")).alias("_lines"))
    return as_findings(
        found.join(lines, ["repo_id", "path"]).select(
            "repo_id", "path", F.lit("U6").alias("rule_id"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"),
            F.lit("homoglyph").alias("category"),
            F.concat(F.lit("Look-alike letters imitate '"), "name", F.lit("'")).alias("title"),
            F.concat(F.lit("'"), "word", F.lit("' reads like '"), "name", F.lit("' but is another identifier.")).alias("description"),
            "line_no",
            context(F.coalesce(F.get("_lines", F.col("line_no") - 1), F.lit("")), F.col("word")).alias("snippet"),
        ),
        "unicode",
    )
