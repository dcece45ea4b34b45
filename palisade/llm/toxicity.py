"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max inverted index, distance-weighted votes.

The examples are a bounded sample of labelled rows, and the index holds every word of theirs. fit() counts these words over all
documents for their IDF, and calibrates the votes on the examples, each judged without itself; beside the votes the calibration sees how
far the labels lie apart at the text's most telling words. score() passes every document once: whole texts, no shuffle, and nothing
of a document but its text. A document whose words equal an example's meets that example at cosine 1.

The index: examples stand in blocks. The words that most examples hold are rows of a dense matrix, which a product adds up for a
batch of texts; words that few examples hold are added up over all blocks at once; the lists between have a maximum a block. So
each block has an upper bound, and blocks are opened by falling bound while it reaches the k-th best cosine. The matrix is in single
precision, so bounds leave it room, and the cosines of all that come near the k best are taken again in double precision.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from palisade.llm.common import release_memory, small_arrow_batches, stored

#: Bound of the fitted sample.
EXAMPLES_PER_LABEL = 4000
#: Examples that must hold a word before it tells labels apart.
LEAST_SUPPORT = 3
NEIGHBOURS = 15
BLOCK = 256
#: Words with longer lists have block maxima.
SHORT_LIST = 32
#: The words with the longest lists are rows of a matrix.
DENSE_WORDS = 384
#: Blocks that are opened at first, and texts that share a product.
FIRST_BLOCKS = 6
TEXTS_AT_ONCE = 128
#: What single precision may be off by.
ROOM = 2e-5
#: Bytes of an Arrow batch: texts stand beside the model in every worker, and twice over in it and on its way.
BATCH_BYTES = "2m"
WORD = re.compile(r"[^\W_]+")
#: The same for Latin-1: what is no letter or digit becomes a blank.
_LATIN = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(256)).encode("latin-1")


def words_of(text: str | None) -> list[str]:
    """The words of a whole text."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def terms_of(text: str | None) -> Counter:
    return Counter(words_of(text))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of lists, and the number of the list each belongs to."""
    of = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths), of


def _numbered(words: pa.Array) -> dict[str, int]:
    return {w: i for i, w in enumerate(words.to_pylist())}


def _opened(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of entries of lists."""
    return entries >> 32, entries.view("<f4")[::2]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; 0 if there are fewer, or it is below 0."""
    return max(0.0, float(np.partition(values, len(values) - k)[len(values) - k])) if len(values) >= k else 0.0


@dataclass
class Model:
    """Vocabulary, IDF, the examples' vectors in block-max form, and the calibration."""

    #: Numbers of words, or the words in order: the driver needs no dictionary of them.
    vocabulary: dict[str, int] | pa.Array
    idf: np.ndarray
    example_ids: np.ndarray
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    k: int = NEIGHBOURS
    #: IDF of words that no example holds, and how far the labels lie apart at each word.
    rare: float = 1.0
    odds: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    base: float = 0.0

    def __post_init__(self) -> None:
        # Examples with the same heaviest word stand together, so the bounds of most blocks are low for any one text.
        size, count = len(self.vocabulary), len(self.vectors)
        heaviest = [int(t[np.argmax(w)]) if len(t) else size for t, w in self.vectors]
        self.order = np.lexsort((self.example_ids, heaviest)) if count else np.empty(0, np.int64)
        self.blocks = -(-count // BLOCK)
        lengths = np.array([len(self.vectors[e][0]) for e in self.order], np.int64)
        term = np.concatenate([np.empty(0, np.int32), *[self.vectors[e][0] for e in self.order]]).astype(np.int32, copy=False)
        sort = np.argsort(term, kind="stable")
        place = np.repeat(np.arange(count, dtype=np.int32), lengths)[sort]
        weight = np.concatenate([np.empty(0, np.float32), *[self.vectors[e][1].astype(np.float32) for e in self.order]])[sort]
        del sort
        # An entry of a list is one number, the place above the bits of the weight: a part of a list is copied once.
        self.entries = place.astype("<i8")
        self.entries <<= 32
        self.entries |= weight.view(np.uint32)
        n = np.bincount(term, minlength=size) if size else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        del term
        common = np.argsort(-n, kind="stable")[:DENSE_WORDS]
        common = np.sort(common[n[common] > SHORT_LIST])
        self.dense_row = np.full(size, -1, np.int32)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        at, of = _gather(self.starts[common], n[common])
        self.dense[of, place[at]] = weight[at]
        # Lists between short and dense: where each block begins in them, and the largest weight in it.
        long = np.flatnonzero((n > SHORT_LIST) & (self.dense_row < 0))
        self.row = np.full(size, -1, np.int32)
        self.row[long] = np.arange(len(long))
        at, of = _gather(self.starts[long], n[long])
        cell = of * self.blocks + place[at] // BLOCK
        cells = np.bincount(cell, minlength=len(long) * self.blocks).reshape(len(long), self.blocks)
        self.block_starts = self.starts[long][:, None] + np.concatenate([np.zeros((len(long), 1), np.int64), np.cumsum(cells, axis=1)], axis=1)
        self.tops = np.zeros(len(long) * self.blocks)
        np.maximum.at(self.tops, cell, weight[at])
        self.tops = self.tops.reshape(len(long), self.blocks)
        self.lists = [self.entries[a:b] for a, b in zip(self.starts[long].tolist(), self.starts[long + 1].tolist())]
        self.query = np.zeros(size)

    def __getstate__(self) -> dict:
        """Without the index, which each worker builds once, and with the vectors end to end."""
        kept = ("idf", "example_ids", "labels", "k", "rare", "odds", "weights", "base")
        lengths = np.array([len(t) for t, _ in self.vectors], np.int64)
        term = np.concatenate([np.empty(0, np.int32), *[t.astype(np.int32) for t, _ in self.vectors]])
        weight = np.concatenate([np.empty(0), *[w for _, w in self.vectors]])
        return {k: self.__dict__[k] for k in kept} | {"packed": (pa.array(list(self.vocabulary), pa.string()) if isinstance(self.vocabulary, dict) else self.vocabulary, lengths, term, weight)}

    def __setstate__(self, state: dict) -> None:
        words, lengths, term, weight = state.pop("packed")
        self.__dict__.update(state)
        self.vocabulary = _numbered(words)
        ends = np.cumsum(lengths)[:-1]
        self.vectors = list(zip(np.split(term, ends), np.split(weight, ends))) if len(lengths) else []
        self.__post_init__()

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and TF-IDF weights of a text of unit length; words that no example holds count in its length."""
        if not isinstance(self.vocabulary, dict):
            self.vocabulary = _numbered(self.vocabulary)
        every = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        counts = np.fromiter(words.values(), float, len(words))
        known = every >= 0
        terms = every[known]
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        raw = 1 + np.log(counts)
        outside = 0.0
        if len(terms) < len(words):
            rest = raw[~known]
            raw, outside = raw[known], float(rest @ rest)
        w = raw * self.idf[terms]
        return terms, w / math.sqrt(w @ w + outside * self.rare * self.rare)

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the dense words add to the cosine of each text with each example."""
        q = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (terms, w) in enumerate(vectors):
            row = self.dense_row[terms]
            q[i, row[row >= 0]] = w[row >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, w: np.ndarray, own: int | None = None, common: np.ndarray | None = None) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a cosine above 0, exactly; ties go to the smaller doc_id.

        own: an example left out. common: the text's row of common_part().
        """
        if not len(terms) or not self.blocks:
            return []
        common = self.common_part([(terms, w)])[0] if common is None else common
        row = self.row[terms]
        is_short, is_long = (row < 0) & (self.dense_row[terms] < 0), row >= 0
        short, long, wide = terms[is_short], row[is_long], w[is_long]
        at, of = _gather(self.starts[short], self.starts[short + 1] - self.starts[short])
        place, weight = _opened(self.entries[at])
        scores = np.bincount(place, w[is_short][of] * weight, len(common)) + common
        if own is not None:
            scores[: len(self.order)][self.order == own] = -1.0
        by_block = scores.reshape(self.blocks, BLOCK)
        bound = by_block.max(axis=1) + (wide @ self.tops[long] if len(long) else 0.0)
        # What the best blocks hold so far is a lower bound of the k-th best cosine: no weight is below 0.
        least = _kth(by_block[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]].ravel(), self.k)
        opened = np.flatnonzero(bound >= max(ROOM, least - ROOM))
        if not len(opened):
            return []
        if len(long):
            scores += self._lists(terms[is_long], wide, None if 2 * len(opened) > self.blocks else opened)
        # So is the k-th largest of the blocks' maxima, which leaves few to rank.
        least = max(least, _kth(by_block[opened].max(axis=1), self.k))
        block, place = np.nonzero(by_block[opened] >= max(ROOM, least - ROOM))
        found = opened[block] * BLOCK + place
        least = _kth(scores[found], self.k)
        found = found[(scores[found] >= least - ROOM) & (found < len(self.order))]
        # The cosines themselves, in double precision.
        self.query[terms] = w
        e = self.order[found]
        take, vectors = self.query.take, self.vectors
        exact = np.array([round(float(take(t).dot(v)), 12) for t, v in map(vectors.__getitem__, e.tolist())])
        self.query[terms] = 0.0
        e, exact = e[exact > 0], exact[exact > 0]
        top = np.lexsort((e, self.example_ids[e], -exact))[: self.k]
        return list(zip(e[top].tolist(), exact[top].tolist()))

    def _lists(self, terms: np.ndarray, w: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
        """What long lists add up to at each place; with blocks, only their parts in these."""
        if not len(terms):
            return np.zeros(self.blocks * BLOCK)
        row = self.row[terms]
        if blocks is None:
            lengths = self.starts[terms + 1] - self.starts[terms]
            parts = [self.lists[r] for r in row.tolist()]
        else:
            first, last = self.block_starts[row][:, blocks].ravel(), self.block_starts[row][:, blocks + 1].ravel()
            lengths, w = last - first, np.repeat(w, len(blocks))
            parts = [self.entries[a:b] for a, b in zip(first.tolist(), last.tolist())]
        place, weight = _opened(np.concatenate(parts))
        return np.bincount(place, weight * np.repeat(w, lengths), self.blocks * BLOCK).astype(float, copy=False)

    def features(self, terms: np.ndarray, found: list[tuple[int, float]]) -> np.ndarray:
        """Vote, largest cosine, their product, the largest log odds of a word of the text, and the mean of the five largest."""
        near = np.array([1 / (1.05 - min(1.0, s)) for _, s in found])
        vote, top = float(near @ self.labels[[e for e, _ in found]] / near.sum()), found[0][1]
        odds = np.sort(self.odds[terms])[-5:] if len(self.odds) else np.zeros(1)
        return np.array([1.0, vote, top, vote * top, odds[-1], odds.sum() / 5])

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """(score, nearest examples) of each text."""
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            vectors = [self.vector(terms_of(t)) for t in texts[at : at + TEXTS_AT_ONCE]]
            common = self.common_part(vectors)
            for (terms, w), row in zip(vectors, common):
                found = self.nearest(terms, w, common=row)
                z = float(np.clip(self.weights @ self.features(terms, found), -30, 30)) if found else 0.0
                out.append((1 / (1 + math.exp(-z)) if found else self.base, found))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _examples(documents: DataFrame, labels: DataFrame, label_col: str, per_label: int) -> tuple[pa.Table, dict[int, int]]:
    """(doc_id, y, words, counts) of the examples, equal ones once, and the number of labelled rows by label."""
    spark = documents.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    schema = "doc_id long, y int, words array<string>, counts array<int>"
    if not drawn:
        return spark.createDataFrame([], schema).toArrow(), totals

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted(terms_of(t.as_py()).items()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("y"), pa.array([[w for w, _ in m] for m in made], pa.list_(pa.string())), pa.array([[n for _, n in m] for m in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "words", "counts"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(spark.createDataFrame(drawn, "doc_id long, y int")), "doc_id")  # bounded by per_label
    counted = stored(sample.select("doc_id", "y", "text").mapInArrow(count, schema), "toxic-examples")
    # A copy says nothing new, so of texts with the same words as often and the same label one is kept; other copies stay.
    once = counted.groupBy("y", "words", "counts").agg(F.min("doc_id").alias("doc_id"))
    return once.select("doc_id", "y", "words", "counts").orderBy("doc_id", "y", "words", "counts").toArrow(), totals


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: int = EXAMPLES_PER_LABEL) -> Model:
    """A model from the labelled documents: (doc_id, text) and (doc_id, label 0 or 1).

    Null ids and labels are left out, a doc_id with several labels takes the largest. Of each label the `per_label` rows with the
    smallest hash of the id are examples, with all their words; a doc_id with several texts gives one example a text. Without
    labelled rows the model scores 0. The model grows with the distinct words of the examples, not with the corpus.
    """
    small_arrow_batches(documents.sparkSession, BATCH_BYTES)
    table, totals = _examples(documents, labels, label_col, per_label)
    ids, y = table.column("doc_id").to_numpy(), table.column("y").to_numpy().astype(float)
    if not len(ids):
        return Model({}, np.empty(0), np.empty(0, np.int64), np.empty(0), [])
    # The words' numbers, in the order in which they first occur, and the examples' vectors end to end: never a Python object a word.
    words = table.column("words").combine_chunks()
    ends = np.cumsum(words.value_lengths().to_numpy(), dtype=np.int64)
    coded = words.flatten().dictionary_encode()
    numbers, words = np.array(coded.indices), coded.dictionary
    counts = table.column("counts").combine_chunks().flatten().to_numpy()
    size = len(words)
    del table, coded

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        number = _numbered(words).get
        # Words that no example holds meet in one more place, which is not returned.
        df, rows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                held = set(words_of(text.as_py()))
                df[np.fromiter(map(number, held, repeat(size)), np.int64, len(held))] += 1
        df = df[:-1]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows))], ["t", "n"])

    counted = documents.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # one row a word of the examples
    t, n = counted.column("t").to_numpy(), counted.column("n").to_numpy()
    df, total = np.zeros(size), int(n[t == -1].sum())
    df[t[t >= 0]] = n[t >= 0]
    idf = np.log((1 + total) / (1 + df)) + 1

    weights, held = 1 + np.log(counts), np.zeros((2, size))
    for start, end, label in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), y):
        sort = np.argsort(numbers[start:end])
        own = numbers[start:end] = numbers[start:end][sort]
        w = weights[start:end][sort] * idf[own]
        weights[start:end] = w / np.linalg.norm(w) if len(w) else w
        held[int(label), own] += 1
    del counts
    vectors = list(zip(np.split(numbers, ends[:-1]), np.split(weights, ends[:-1])))
    release_memory()
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    log_odds = np.log((held[1] + 0.5) / (sizes[1] + 1)) - np.log((held[0] + 0.5) / (sizes[0] + 1))
    odds = np.where(held.sum(axis=0) >= LEAST_SUPPORT, log_odds, 0.0)
    model = Model(words, idf, ids, y, vectors, rare=math.log((1 + total) / 2) + 1, odds=odds)

    # Calibration at the labels' own shares: each example is judged without itself.
    share_of = {label: totals.get(label, 0) / max(1, sizes[label]) for label in (0, 1)}
    weight = np.array([share_of[int(v)] for v in y])
    release_memory()
    some, features = np.zeros(len(y), bool), []
    for i, (terms, w) in enumerate(model.vectors):
        found = model.nearest(terms, w, own=i)
        if found:
            some[i] = True
            features.append(model.features(terms, found))
    model.base = float((weight * y)[~some].sum() / (weight[~some].sum() + 1)) if (~some).any() else float((weight * y).sum() / weight.sum())
    if some.any():
        model.weights = _logistic(np.array(features), y[some], weight[some] / weight.mean())
    return model


def _in_task(shared: Broadcast) -> Model:
    """The model, which a worker loads once: after it gave back what earlier stages held, and without what loading took."""
    release_memory()
    model = shared.value
    release_memory()
    return model


def score(documents: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """documents with score double (0 to 1), predicted int (1 from 0.5 on) and evidence (the nearest examples).

    Null and empty texts, and texts without any word of the examples, get the share of toxic rows among examples without a
    neighbour. Only the text is read: documents of the same text score alike, examples too. Texts of any length are read whole.
    Columns of the new names are replaced; other columns are kept whatever they are called.
    """
    small_arrow_batches(documents.sparkSession, BATCH_BYTES)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    new = [f"{prefix}score", f"{prefix}predicted", f"{prefix}evidence"]
    rest = documents.drop(*new)
    kind = "array<struct<doc_id:long,label:int,cosine:double>>"
    schema = StructType([*rest.schema.fields, *StructType.fromDDL(f"`{new[0]}` double, `{new[1]}` int, `{new[2]}` {kind}").fields])
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _in_task(shared)
        for batch in batches:
            made = model.judge(batch.column("text").to_pylist())
            scores = [s for s, _ in made]
            near = np.array([e for _, found in made for e, _ in found], np.int64)
            cosines = pa.array([c for _, found in made for _, c in found], pa.float64())
            ends = pa.array(np.cumsum([0, *(len(found) for _, found in made)]), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(model.example_ids[near], pa.int64()), pa.array(model.labels[near].astype(np.int32)), cosines], fields=list(arrow.value_type))
            evidence = pa.ListArray.from_arrays(ends, flat).cast(arrow)
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), evidence]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *new])

    made = rest.mapInArrow(judge, schema)
    release_memory()
    return made


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those predicted toxic; columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    small_arrow_batches(documents.sparkSession, BATCH_BYTES)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _in_task(shared)
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s, _ in model.judge(batch.column("text").to_pylist())], pa.bool_()))

    kept = documents.mapInArrow(keep, documents.schema)
    release_memory()
    return kept
