"""URL filters with Bloom filter cascades.

A cascade answers membership exactly for every key of a known universe, here all keys that the corpus can ask for. Level 0
encodes the listed keys; level 1 the unlisted keys of the universe that level 0 lets through; level 2 the listed keys that
level 1 lets through; and so on until a level lets nothing wrong through. A key is listed if the first level that rejects it
is an odd one, or if no level rejects it and their number is odd.

Keys are dealt by hash into shards of bounded size, and each shard builds its own cascade in one task from 16 bytes a key. The
finished levels hold a few bits for each listed key. They are sent to the tasks if together they stay below a bound that is
checked; beyond it the distinct keys meet the cascade of their shard by a grouping on the shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import free_names, shard_count, stored

KEYS_PER_SHARD = 1_000_000
SEND_BOUND = 64 * 1024 * 1024
SEED = 7
LEVELS = "shard int, level int, hashes int, size long, bits binary"


def hashes(key: Column) -> Column:
    """128 bits of a key, the only thing that filters ever see."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(SEED)).alias("b"))


def _places(a: np.ndarray, b: np.ndarray, n: int, size: int, level: int) -> np.ndarray:
    """n bit positions of each key, other ones at each level."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
    x, y = a.view(np.uint64) * (salt | np.uint64(1)), (b.view(np.uint64) ^ salt) | np.uint64(1)
    x ^= x >> np.uint64(29)
    at = x[:, None] + y[:, None] * np.arange(1, n + 1, dtype=np.uint64)[None, :]
    at ^= at >> np.uint64(32)
    return (at * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)) % np.uint64(size)


def _let_through(a: np.ndarray, b: np.ndarray, n: int, size: int, level: int, bits: np.ndarray) -> np.ndarray:
    at = _places(a, b, n, size, level)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_levels(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Levels (hashes, size, bits) over distinct keys. No listed key: no level."""
    inside, outside, levels = (a[listed], b[listed]), (a[~listed], b[~listed]), []
    while len(inside[0]):
        level, n = len(levels), len(inside[0])
        rate = 0.5 if level else min(0.5, max(1e-6, n / (math.sqrt(2) * max(1, len(outside[0])))))
        k = max(1, round(-math.log2(rate)))
        size = max(64, math.ceil(n * k / math.log(2)) + level)
        bits = np.zeros(size // 8 + 1, np.uint8)
        at = _places(*inside, k, size, level).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
        levels.append((k, size, bits))
        wrong = _let_through(*outside, k, size, level, bits) if len(outside[0]) else np.zeros(0, bool)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def ask(levels: list[tuple[int, int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys are listed."""
    answer, open_ = np.full(len(a), len(levels) % 2 == 1), np.arange(len(a))
    for level, (k, size, bits) in enumerate(levels):
        passed = _let_through(a[open_], b[open_], k, size, level, bits) if len(open_) else np.zeros(0, bool)
        answer[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
    return answer


@dataclass
class Cascade:
    """levels: a stored table; shards: their number; sent: levels by shard, or None where they are too large to send."""

    levels: DataFrame
    shards: int
    sent: dict[int, list[tuple[int, int, np.ndarray]]] | None


def _by_shard(rows: list) -> dict[int, list[tuple[int, int, np.ndarray]]]:
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["level"])):
        found.setdefault(r["shard"], []).append((r["hashes"], r["size"], np.frombuffer(r["bits"], np.uint8)))
    return found


def build(listed: DataFrame, universe: DataFrame, keys_per_shard: int = KEYS_PER_SHARD, send_bound: int = SEND_BOUND) -> Cascade:
    """The cascade of the listed keys over a universe of keys; both are tables of one string column.

    Null keys are left out, repeated keys count once, a listed key need not occur in the universe. An empty list gives a cascade
    that lists nothing.
    """
    one = lambda df, flag: df.select(F.col(df.columns[0]).alias("key")).where("key is not null").select(hashes(F.col("key")).alias("h"), F.lit(flag).alias("l"))
    keys = stored(one(universe, 0).union(one(listed, 1)).groupBy("h").agg(F.max("l").alias("listed")).select("h.a", "h.b", "listed"), "keys")
    shards = shard_count(keys.count(), keys_per_shard)

    def level_rows(frame: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(frame["a"].to_numpy(), frame["b"].to_numpy(), frame["listed"].to_numpy() == 1)
        return pd.DataFrame([(frame["shard"].iloc[0], i, k, size, bits.tobytes()) for i, (k, size, bits) in enumerate(levels)], columns=["shard", "level", "hashes", "size", "bits"])

    sharded = keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    levels = stored(sharded.groupBy("shard").applyInPandas(level_rows, LEVELS), "cascade")
    size = levels.agg(F.sum(F.length("bits") + 100)).first()[0] or 0
    return Cascade(levels, shards, _by_shard(levels.collect()) if size <= send_bound else None)


def listed_flags(cascade: Cascade, keys: Column) -> Column:
    """For an array of keys, which are listed; a null array gives null. Needs levels that could be sent."""
    if cascade.sent is None:
        raise ValueError("the levels are too large to send; use mark()")
    levels, shards = cascade.sent, cascade.shards

    @F.pandas_udf("array<boolean>")
    def flags(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = np.array([0 if x is None else len(x) for x in a], np.int64)
        flat_a = np.concatenate([np.asarray(x, np.int64) for x in a if x is not None and len(x)] or [np.empty(0, np.int64)])
        flat_b = np.concatenate([np.asarray(x, np.int64) for x in b if x is not None and len(x)] or [np.empty(0, np.int64)])
        shard, answer = np.mod(flat_a, shards), np.zeros(len(flat_a), bool)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            answer[at] = ask(levels.get(int(s), []), flat_a[at], flat_b[at])
        parts = np.split(answer, np.cumsum(sizes)[:-1]) if len(sizes) else []
        return pd.Series([None if x is None else p.tolist() for x, p in zip(a, parts)], dtype=object)

    return flags(F.transform(keys, lambda k: F.xxhash64(k)), F.transform(keys, lambda k: F.xxhash64(k, F.lit(SEED))))


def mark(rows: DataFrame, cascade: Cascade, keys: str, to: str) -> DataFrame:
    """rows with an array of booleans beside the array column of keys.

    Levels that could be sent answer in place. Larger ones answer for the distinct keys, grouped by shard, and the answers come
    back by key; `rows` must then be a stored table, since it is read twice.
    """
    if cascade.sent is not None:
        return rows.withColumn(to, listed_flags(cascade, F.col(keys)))
    shards = cascade.shards

    def answer(levels: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = _by_shard(levels.to_dict("records"))
        got = ask(next(iter(own.values()), []), asked["a"].to_numpy(np.int64), asked["b"].to_numpy(np.int64))
        return pd.DataFrame({"key": asked["key"], "listed": got})

    key = rows.select(F.explode(keys).alias("key")).distinct().withColumn("h", hashes(F.col("key"))).select("key", "h.a", "h.b")
    asked = key.withColumn("of", F.pmod("a", F.lit(shards)).cast("int"))
    answers = cascade.levels.groupBy("shard").cogroup(asked.groupBy("of")).applyInPandas(answer, "key string, listed boolean")
    (row,) = free_names([*rows.columns, to, "_at", "key"], "_row")
    named = rows.withColumn(row, F.monotonically_increasing_id())
    flags = named.select(row, F.posexplode(keys).alias("_at", "key")).join(answers, "key").groupBy(row)
    flags = flags.agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "listed"))), lambda x: x["listed"]).alias(to))
    none = F.when(F.col(keys).isNotNull(), F.expr("cast(array() as array<boolean>)"))
    return named.join(flags, row, "left").withColumn(to, F.coalesce(to, none)).drop(row)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; else both empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.substr(text, F.locate("://", text) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host suffix at a label boundary with every path start of a listed length, longest key first, then longest host."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths)])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.struct(-(F.char_length(s) + F.char_length(p)), -F.char_length(s), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(F.when(host != "", pairs).otherwise(F.slice(pairs, 1, 0))), lambda x: x["key"])


def judge_urls(pages: DataFrame, allow: DataFrame, block: DataFrame, path_lengths: list[int], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest listed key that fits, else null), rule_verdict (allow, block or null).

    allow and block: tables of keys host + path start, whose path starts have the lengths given. A key on both lists is blocked.
    Null urls and urls without :// have an empty host and path and fit nothing; empty tables and lists are fine; repeated rows
    are judged alike. Columns of pages with the names of the new ones are replaced.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "rule_verdict").withColumns({"host": host, "path": path})
    keys, allowed, blocked, best = free_names([*rows.columns, "rule", "rule_verdict"], "_keys", "_allow", "_block", "_hit")
    rows = rows.withColumn(keys, candidate_keys(F.col("host"), F.col("path"), path_lengths))
    universe = rows.select(F.explode(keys).alias("key"))
    lists = [build(allow, universe), build(block, universe)]
    if any(x.sent is None for x in lists):
        rows = stored(rows, "urls")
    rows = mark(mark(rows, lists[0], keys, allowed), lists[1], keys, blocked)
    hit = F.transform(F.arrays_zip(keys, allowed, blocked), lambda x: F.struct(x[keys].alias("rule"), F.when(x[blocked], "block").when(x[allowed], "allow").alias("verdict")))
    first = F.get(F.filter(hit, lambda x: x["verdict"].isNotNull()), F.lit(0))
    return rows.withColumn(best, first).withColumns({"rule": F.col(best)["rule"], "rule_verdict": F.col(best)["verdict"]}).drop(keys, allowed, blocked, best)
