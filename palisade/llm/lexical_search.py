"""Ranked lexical search, reversed: the items are the index, the documents stream past it.

The distinct terms of the items form an inverted index (term -> items), cut into blocks of items that hold at most
POSTINGS_PER_BLOCK postings; a block is sent to all tasks. One pass over the documents counts their number, their terms and in how
many of them each term of the block occurs. A second pass looks up each document's term counts in the index, adds up the scores
of all items a document touches, and keeps a bounded heap of the best documents an item. The heaps of all tasks are merged in two
steps, so that no item gathers the heaps of a large table in one go. Scores are 64-bit integers, hence independent of any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import shard_count, small_arrow_batches
from palisade.llm.license_join import words

#: Bound of what is sent to all tasks: postings of a block of items. An item's distinct terms stay together.
POSTINGS_PER_BLOCK = 500_000
#: Score cells (documents x items) and postings that a task adds up in one go.
CELLS = 2_000_000
MERGE_PARTS = 32
#: Fixed values of the score.
SCALE, B_PERCENT, K1_TENTHS = 1000, 90, 8
_ALNUM = set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_FOLDED = bytes(c if c >= 0x80 or c in _ALNUM else 0x20 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and non-ASCII characters of a UTF-8 text."""
    return text.translate(_FOLDED).split() if text else []


@dataclass
class Index:
    """Terms of a block of items with their postings: items[starts[t]:starts[t + 1]] hold term t."""

    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    item_ids: list[int | None]

    @classmethod
    def of(cls, table: pa.Table) -> Index:
        """From distinct (item_id, term) rows."""
        ids = table.column("item_id").to_pylist()
        item_ids = sorted(set(ids), key=lambda i: (i is None, i or 0))
        place = {i: at for at, i in enumerate(item_ids)}
        items = np.array([place[i] for i in ids], np.int64)
        terms: dict[bytes, int] = {}
        numbers = np.array([terms.setdefault(t.encode(), len(terms)) for t in table.column("term").to_pylist()], np.int64)
        order = np.lexsort((items, numbers))
        starts = np.searchsorted(numbers[order], np.arange(len(terms) + 1))
        return cls(terms, starts, items[order], item_ids)


def document_counts(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """(t, n): documents that hold term t; -1 counts documents with a term, -2 all terms with repeats."""
    known, df, rows, total = index.terms, np.zeros(len(index.terms), np.int64), 0, 0
    for batch in batches:
        for text in batch.column(0):
            found = terms_of(text.as_py())
            rows, total = rows + bool(found), total + len(found)
            df[[known[t] for t in known.keys() & set(found)]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [rows, total]), pa.int64())], ["t", "n"])


class Heaps:
    """The k best (score, doc_id) of each item; equal scores go to the smaller id, a null id stands behind all others."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc, self.null = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64), np.zeros((items, k), bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
        """scores[document, item]; only those that can enter a heap are sorted."""
        d, i = np.nonzero((scores > 0) & (scores >= self.score[:, -1]))
        if not len(d):
            return
        own = np.unique(i)
        item = np.concatenate([np.repeat(own, self.k), i])
        score = np.concatenate([self.score[own].ravel(), scores[d, i]])
        doc, null = np.concatenate([self.doc[own].ravel(), docs[d]]), np.concatenate([self.null[own].ravel(), nulls[d]])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        first = np.searchsorted(item, own)
        best = (first[:, None] + np.arange(self.k)).ravel()
        self.score[own], self.doc[own], self.null[own] = (x[best].reshape(-1, self.k) for x in (score, doc, null))

    def rows(self, item_ids: list[int | None]) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > 0)
        doc = pa.array(self.doc[i, j], pa.int64(), mask=self.null[i, j])
        return pa.RecordBatch.from_arrays([pa.array([item_ids[x] for x in i.tolist()], pa.int64()), doc, pa.array(self.score[i, j], pa.int64())], ["item_id", "doc_id", "score"])


def best_documents(batches: Iterator[pa.RecordBatch], index: Index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """The task's heaps over its (doc_id, text) rows."""
    known, keys, width = index.terms, index.terms.keys(), len(index.item_ids)
    heaps, length = Heaps(width, k), np.diff(index.starts)
    docs: list[int | None] = []
    of, term, tf, m = [], [], [], []
    postings = 0

    def flush() -> None:
        t, f = np.array(term, np.int64), np.array(tf, np.int64)
        part = weight[t] * ((SCALE**3 * f) // (SCALE * f + K1_TENTHS * np.array(m, np.int64)))
        n = length[t]
        rows = np.repeat(np.arange(len(t)), n)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.starts[t], n)
        scores = np.zeros(len(docs) * width, np.int64)
        np.add.at(scores, np.array(of, np.int64)[rows] * width + index.items[at], part[rows])
        null = np.array([d is None for d in docs], bool)
        heaps.add(scores.reshape(len(docs), width), np.array([d or 0 for d in docs], np.int64), null)
        for x in (docs, of, term, tf, m):
            x.clear()

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            found = terms_of(text.as_py())
            counts = Counter(found)
            hits = keys & counts.keys()
            if not hits:
                continue
            norm = 100 - B_PERCENT + (B_PERCENT * len(found) * n_docs) // n_terms
            for t in hits:
                number = known[t]
                term.append(number)
                tf.append(counts[t])
                postings += int(length[number])
            of.extend([len(docs)] * len(hits))
            m.extend([norm] * len(hits))
            docs.append(doc.as_py())
            if len(docs) * width >= CELLS or postings >= CELLS:
                flush()
                postings = 0
    if docs:
        flush()
    yield heaps.rows(index.item_ids)


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, postings_per_block: int = POSTINGS_PER_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    documents: (doc_id, text); items: (item_id, text); ids become long, other columns are ignored. Null and empty texts have no
    term: such documents count nowhere, such items get no row. Rows that share an item_id, null included, are one item with the
    terms of all. Each document row is a document of its own, also a repeated one; equal scores go to the smaller doc_id, a null
    doc_id stands last. Texts of any length are read whole, one row at a time. An empty table on either side gives no row.
    """
    spark = documents.sparkSession
    small_arrow_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words(F.col("text"))).alias("term")).distinct()
    blocks = shard_count(own.count(), postings_per_block)
    found = None
    for block in range(blocks):
        some = own.where(F.pmod(F.xxhash64("item_id", F.lit(11)), F.lit(blocks)) == block)
        part = _block(docs, Index.of(some.toArrow()), k)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, index: Index, k: int) -> DataFrame:
    counted = docs.select("text").mapInArrow(lambda batches: document_counts(batches, index), "t long, n long")
    counts = {r["t"]: r["n"] for r in counted.groupBy("t").agg(F.sum("n").alias("n")).collect()}  # at most the block's terms
    n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(len(index.terms))
    df[list(counts)] = list(counts.values())
    weight = np.floor(SCALE * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    kind = "item_id long, doc_id long, score long"
    return docs.mapInArrow(lambda batches: best_documents(batches, index, weight, n_docs, n_terms, k), kind)
