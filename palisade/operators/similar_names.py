"""Names that resemble popular ones, for lists of any size: an index on rare letters ahead of the exact ratio.

The ratio of two names is 2 M / (length + length), M being the letters of their matching blocks, so they share at least
need = ceil(least * (la + lb) / 2) letters, counted with multiplicity. A letter and its number within the name ("e", 2) is a token;
tokens go in one order, rarest first. Two names with `need` common tokens have one among the first la - need + 1 and lb - need + 1 of
them: only these meet, and only names whose lengths allow the ratio. A pair is taken at its first common token, so it comes out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators.dependencies import MIN_RATIO, similarity
from palisade.operators.joins import salted_join


def _tokens(names: DataFrame, name: str) -> DataFrame:
    """name, its length, and its (letter, number) tokens, each as one number: the letter's bytes, then its number in 30 bits."""
    letters = F.array_sort(F.split(F.col(name), ""))
    numbered = F.transform(letters, lambda c, i: F.conv(F.hex(c), 16, 10).cast("long") * (1 << 30) + i - F.array_position(letters, c) + 1)
    return names.where((F.length(name) > 0)).select(name, F.length(name).alias("n"), numbered.alias("tokens")).distinct()


def _need(a: Column, b: Column, least: float) -> Column:
    return F.ceil(F.lit(least) * (a + b) / 2 - F.lit(1e-9)).cast("int")


def _indexed(tokens: DataFrame, order: DataFrame, name: str, own: str, other: str, least: float) -> DataFrame:
    """One row for each prefix token and length of a partner."""
    placed = tokens.select(name, "n", F.explode("tokens").alias("token")).join(order, "token")
    ranked = placed.groupBy(name, "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t"))
    low = F.ceil(F.col("n") * least / (2 - least) - F.lit(1e-9)).cast("int")
    high = F.floor(F.col("n") * (2 - least) / least + F.lit(1e-9)).cast("int")
    wide = ranked.select(name, F.col("n").alias(own), "t", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias(other))
    prefix = F.slice("t.token", F.lit(1), F.col(own) - _need(F.col(own), F.col(other), least) + 1)
    return wide.select(name, own, other, F.col("t.token").alias(f"{name}_tokens"), F.explode(prefix).alias("token"))


def bound_pairs(names: DataFrame, popular: DataFrame, least: float = MIN_RATIO) -> DataFrame:
    """name, popular, shared: all pairs whose lengths and shared letters allow the ratio; equal names are left out.

    names: (name), popular: (popular). Nulls and empty names meet nothing; repeated ones count once.
    """
    a, b = _tokens(names, "name"), _tokens(popular, "popular")
    order = a.select("tokens").unionByName(b.select("tokens")).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    left, right = _indexed(a, order, "name", "la", "lb", least), _indexed(b, order, "popular", "lb", "la", least)
    met = salted_join(left, right, ["token", "la", "lb"]).where("name <> popular")
    # Tokens stand in the common order, of which prefixes are the beginning: the first common token of both names is the first of the prefixes
    # too, and all of them are the shared letters. A one-row generator keeps the optimizer from comparing a pair twice.
    common = met.select("name", "popular", "la", "lb", "token", F.explode_outer(F.array(F.array_intersect("name_tokens", "popular_tokens"))).alias("common"))
    taken = common.where((F.get("common", F.lit(0)) == F.col("token")) & (F.size("common") >= _need(F.col("la"), F.col("lb"), least)))
    return taken.select("name", "popular", F.size("common").alias("shared"))


def similar_names(names: DataFrame, popular: DataFrame, least: float = MIN_RATIO) -> DataFrame:
    """name, popular, ratio of every pair with a ratio from ``least`` up to, but not, 1; the ratio is taken only where the bounds allow it."""
    pairs = bound_pairs(names, popular, least)
    return pairs.select("name", "popular", similarity("name", "popular").alias("ratio")).where((F.col("ratio") >= least) & (F.col("ratio") < 1.0))
