"""Exact top-k search: exhaustive term-at-a-time accumulation over weighted postings, then selection and merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import shard_count

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
SCORES = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>) with v = floor(scale * x); null ids and vectors that are null, empty or hold null or non-finite parts are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull()
    scaled = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def _counted(frame: DataFrame, k: int) -> DataFrame:
    """Equal (vec_id, v) rows as one with their number n, of which at most k can be among the k best."""
    return frame.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))


def _rows(frame: pd.DataFrame) -> tuple[np.ndarray, list]:
    """Ids and vectors of the rows, each as often as it is counted, by id."""
    ids, vectors = frame["vec_id"].to_numpy(), [tuple(v) for v in frame["v"]]
    order = np.argsort(ids, kind="stable")
    order = np.repeat(order, frame["n"].to_numpy()[order])
    return ids[order], [vectors[i] for i in order]


def _postings(vectors: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per term (dimension) the rows with a weight other than zero and these weights."""
    width = max(map(len, vectors), default=0)
    dense = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    return [(at := np.flatnonzero(dense[:, t]), dense[at, t]) for t in range(width)], width


def score_block(query_ids: np.ndarray, queries: list, ids: np.ndarray, vectors: list, k: int) -> pd.DataFrame:
    """The k best rows of the block for each query; ids ascend, so ties go to the smaller one."""
    postings, width = _postings(vectors)
    most = max((abs(x) for v in vectors for x in v), default=0) * max((abs(x) for v in queries for x in v), default=0) * max(width, 1)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    postings = [(at, w.astype(kind)) for at, w in postings]
    out = []
    for start in range(0, len(queries), 64):
        part = queries[start : start + 64]
        scores = np.zeros((len(part), len(ids)), kind)
        for t in range(min(width, max(map(len, part), default=0))):
            at, weights = postings[t]
            full = len(at) == len(ids)
            for row, q in enumerate(part):
                if t < len(q) and q[t] and len(at):
                    if full:
                        scores[row] += q[t] * weights
                    else:
                        scores[row, at] += q[t] * weights
        for row in range(len(part)):
            query = query_ids[start + row]
            others = np.flatnonzero(ids != query)
            s = scores[row, others]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                others, s = others[s >= least], s[s >= least]
            best = np.lexsort((ids[others], -s))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[others[best]], "score": s[best].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})


def top_k(rows: DataFrame, queries: DataFrame, k: int, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query, over every row but its own.

    rows and queries: (vec_id long, v array<long>). Both are counted by value and dealt into blocks by a hash of it, so neither
    copies nor a frequent id fill one block; each pair of blocks is one task of bounded size, which scatters the query weights over
    the postings of its rows, term by term, into a score array. Ties go to the smaller vec_id. A repeated row is a candidate, or a
    query, as often as it occurs; rows that share the query's vec_id count as its own; all queries of one id are ranked together.
    Shorter vectors end in zeros. No queries or no rows: no result.
    """
    n_rows, n_queries = (x.count() for x in (rows, queries))
    row_blocks, query_blocks = shard_count(n_rows, rows_per_block), shard_count(n_queries, queries_per_block)

    def dealt(frame: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id", "v"), F.lit(own_n)).cast("int")
        return _counted(frame, k).select("vec_id", "v", "n", at.alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other))

    left = dealt(queries, "q", query_blocks, "r", row_blocks).groupBy("q", "r")
    right = dealt(rows, "r", row_blocks, "q", query_blocks).groupBy("q", "r")

    def score(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return score_block(np.empty(0, np.int64), [], np.empty(0, np.int64), [], k)
        return score_block(*_rows(one), *_rows(two), k)

    found = left.cogroup(right).applyInPandas(score, SCORES)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
