"""License scans: exact set-similarity join between blocks of texts and license templates, in DataFrame functions only.

The blocks of a template of L words are all runs of 2 L consecutive words of a line (a shorter line is one block), and all runs of
L consecutive words of the text, across line ends. A block meets a template T if it holds at least `threshold` of T's distinct
words. Words are put in one global order, rarest in the corpus first. At least need = ceil(threshold * |T|) of T's words must
occur, so one of its first |T| - need + 1 words does: only these are joined with the words of the lines and texts (prefix filter).
A line or text with fewer than `need` distinct words is out (length filter), and so is a pair whose first common word stands so
late in T that too few words can follow (positional filter). What is left is verified on every block that begins with a word of T.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import text_key

#: What is not a letter, digit or non-ASCII character separates words; the same with capitals still in place.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD = "0.8"
#: Our own short forms of widely used license notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under the creative commons attribution sharealike 4 0 international license",
    "cc0-1.0": "released into the public domain under cc0 1 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
}
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sequence(text: Column) -> Column:
    """Lower-cased words of a text in their order."""
    return F.array_remove(F.split(F.translate(text, *LOWER), GAP), "")


def words(text: Column) -> Column:
    """Distinct lower-cased words of a text, as a set."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, *LOWER), GAP)), "")


def phrase_pattern(phrase: str) -> str:
    """The words of a phrase, consecutive; capitals are free."""
    return rf"(?i)(?<!{ANY_CASE_WORD[:-1]}){GAP.join(phrase.split(' '))}(?!{ANY_CASE_WORD[:-1]})"


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> list[Column]:
    """n_words, n_base, first_word, last_word and base_labels of a text that is not null."""
    count = lambda c: F.regexp_count(c, F.lit(ANY_CASE_WORD)).cast("long")
    patterns = {p: phrase_pattern(p) for p in phrases}
    hint = "(?i)" + "|".join(p.split(" ")[-1] for p in phrases)
    maybe = text.rlike(hint)
    anyone = "|".join(x.removeprefix("(?i)") for x in patterns.values())
    some = maybe & text.rlike(f"(?i)(?:{anyone})")
    n = F.when(some, sum((F.regexp_count(text, F.lit(x)) for x in patterns.values()), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
    first = F.when(some, count(F.regexp_extract(text, rf"(?is)\A(.*?)(?:{anyone})", 1)))
    last = F.when(some, count(F.regexp_extract(text, rf"(?is)\A(.*)(?:{anyone})", 1)))
    labels = F.array(*[F.when(some & text.rlike(patterns[p]), F.lit(label)) for p, label in sorted(phrases.items(), key=lambda x: x[1])])
    return [count(text).alias("n_words"), n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_join(F.array_distinct(labels), ",").alias("base_labels")]


def word_order(texts: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that hold each word, rarest first; equal numbers go by the word itself.

    The vocabulary is that of the templates, so what is collected never grows with the texts.
    """
    own = F.array_intersect(words(F.coalesce(F.col(text_col), F.lit(""))), F.array(*[F.lit(w) for w in vocabulary]))
    counts = {r["w"]: r["n"] for r in texts.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def license_blocks(texts: DataFrame, key_cols: list[str], text_col: str, templates: dict[str, str] = TEMPLATES, threshold: str = THRESHOLD) -> DataFrame:
    """(key columns, line int, label, containment double): the best block of every line that meets a template, and of every text.

    Lines end at \\n and count from 0; the text itself is number -1. Null and empty texts, and lines without words, meet nothing.
    Repeated rows come back as often. threshold is a decimal text, so that need is exact.
    """
    spark = texts.sparkSession
    sets = {label: sorted(set(t.split(" "))) for label, t in templates.items()}
    need = {label: math.ceil(Fraction(threshold) * len(own)) for label, own in sets.items()}
    order = word_order(texts, text_col, sorted({w for own in sets.values() for w in own}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, own in sets.items():
        ordered = sorted(own, key=rank.__getitem__)
        prefix = ordered[: len(own) - need[label] + 1]
        index += [(w, at, label, ordered, prefix, need[label], len(templates[label].split(" "))) for at, w in enumerate(prefix)]
    prefixes = spark.createDataFrame(index, "word string, at int, label string, template array<string>, prefix array<string>, need int, length int")

    rare = sorted({w for w, *_ in index})
    some = rf"(?i)(?<!{ANY_CASE_WORD[:-1]})(?:{'|'.join(rare)})(?!{ANY_CASE_WORD[:-1]})"
    text = F.col(text_col)
    parts = F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("_part", "_line")
    lines = texts.where(text.rlike(some)).select(*key_cols, parts).where(F.col("_line").rlike(some))
    lines = lines.select(*key_cols, (F.col("_part") - 1).alias("line"), word_sequence(F.col("_line")).alias("_sequence")).withColumn("_words", F.array_distinct("_sequence"))
    probes = lines.withColumn("word", F.explode(F.array_intersect("_words", F.array(*[F.lit(w) for w in rare]))))
    pairs = probes.join(F.broadcast(prefixes), "word")  # bounded by the templates
    once = F.get(F.array_intersect("prefix", "_words"), F.lit(0)) == F.col("word")
    long_enough = F.size("_words") >= F.col("need")
    can_reach = F.size("template") - F.col("at") >= F.col("need")
    common = F.size(F.array_intersect("template", "_words"))
    found = pairs.where(once & long_enough & can_reach).withColumn("_common", common).where(F.col("_common") >= F.col("need"))
    span = F.when(F.col("line") < 0, F.col("length")).otherwise(2 * F.col("length"))
    starts = F.filter(F.sequence(F.lit(1), F.size("_sequence")), lambda i: F.array_contains("template", F.get("_sequence", i - 1)))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("template", F.slice("_sequence", i, span)))))
    found = found.withColumn("_common", F.when(F.size("_sequence") <= span, F.col("_common")).otherwise(best)).where(F.col("_common") >= F.col("need"))
    return found.select(*key_cols, "line", "label", (F.col("_common") / F.size("template")).alias("containment"))


def license_scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: str = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of (doc_id, text).

    score is 1 for a phrase, else the largest containment of a line that meets a template, else 0. Null texts count as empty;
    null ids stay; repeated rows come back as often, with equal values.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key("text").alias("_key"))
    found = license_blocks(docs, ["_key"], "text", templates, threshold).groupBy("_key").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    base = docs.select("doc_id", "_key", *phrase_places(F.col("text")))
    own = F.when(F.col("base_labels") != "", F.split("base_labels", ",")).otherwise(F.expr("cast(array() as array<string>)"))
    labels = F.array_join(F.array_sort(F.array_union(own, F.coalesce("_labels", F.expr("cast(array() as array<string>)")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return base.join(found, "_key", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
