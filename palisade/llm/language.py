"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of anything but letters and marks become one boundary. N-grams of one to four characters that do not
cross a boundary are hashed into 2^BITS features, whole texts piece by piece. Document frequencies are counted over every training
row. The weights come from a bounded sample of training rows (PER_LANGUAGE rows of each of at most MAX_LANGUAGES languages), which
one task passes EPOCHS times in a hashed order through follow-the-regularised-leader steps with an elastic net, so its memory
holds the weights and one row. The rows of the sample that are kept back set the temperature of the probabilities.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from palisade.llm.common import small_arrow_batches, stored

BITS = 16
LONGEST = 4
#: Bounds of the fitted sample.
PER_LANGUAGE = 1500
MAX_LANGUAGES = 128
EPOCHS = 3
#: One in this many rows of the sample is kept back for the temperature.
KEPT_BACK = 5
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.001
PIECE = 1 << 18
UNKNOWN = "und"
_MIX, _STEP = np.uint32(0x9E3779B1), np.uint32(0x01000193)


@functools.cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter (1) or a mark (2)."""
    kinds = {"L": 1, "M": 2}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def _features(codes: np.ndarray, old: int) -> np.ndarray:
    """Features of the n-grams that end behind the first `old` codes, sorted; 0 is a boundary."""
    made = []
    for n in range(1, LONGEST + 1):
        first = max(old - n + 1, 0)
        count = len(codes) - n + 1 - first
        if count <= 0:
            continue
        grams = [codes[first + k : first + k + count] for k in range(n)]
        h = grams[0] ^ np.uint32(n)
        for g in grams[1:]:
            h = (h * _STEP) ^ g
        h = (h * _MIX) >> np.uint32(32 - BITS)
        inner = grams if n == 1 else grams[1:-1]
        made.append(h[np.logical_and.reduce([g != 0 for g in inner])] if inner else h)
    out = np.concatenate(made) if made else np.empty(0, np.uint32)
    out.sort()
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text; both empty if it has no letter."""
    kinds, whole, carry, letter = _letters(), None, np.zeros(1, np.uint32), False
    text = text or ""
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(text) + 1, PIECE):
        part = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[part]
        letter = letter or bool((kind == 1).any())
        last = at + PIECE > len(text)
        codes = np.concatenate([carry, np.where(kind > 0, part, np.uint32(0)), carry[:0] if not last else np.zeros(1, np.uint32)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        features = _features(codes, len(carry))
        first = np.flatnonzero(np.diff(features, prepend=np.uint32(1 << BITS)))
        found, counts = features[first].astype(np.int64), np.diff(first, append=len(features))
        if not last or whole is not None:
            whole = np.zeros(1 << BITS, np.int64) if whole is None else whole
            whole[found] += counts
        carry = codes[-(LONGEST - 1) :]
    if whole is not None:
        found = np.flatnonzero(whole)
        counts = whole[found]
    return (found, counts) if letter else (found[:0], counts[:0])


@dataclass
class Model:
    """Learned languages, IDF, sparse weights and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def judge(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (ties: the first by name) and its probability; a text without a letter is unknown, with 0."""
        found, counts = gram_counts(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        x = vector(counts, self.idf[found])
        p = softmax((x @ self.weights[found] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights."""
    x = (1 + np.log(counts)) * idf
    return x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow the regularised leader, by coordinate, for a multinomial logistic loss with an elastic net."""

    def __init__(self, classes: int, features: int = 1 << BITS):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def step(self, found: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example; the last coordinate is the bias."""
        at, x = np.append(found, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss, by golden sections of its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(batches: Iterator[pa.RecordBatch], idf: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """(feature, class, weight) of (epoch, label, found, counts) rows by epoch; rows of the epoch after the last set the temperature.

    Feature -1 is the bias, -2 the temperature.
    """
    leader, logits, labels = Leader(classes), [], []
    for batch in batches:
        columns = (batch.column(c) for c in ("epoch", "label", "found", "counts"))
        for epoch, label, found, counts in zip(*columns):
            found, label = np.asarray(found.values), label.as_py()
            x = vector(np.asarray(counts.values).astype(float), idf[found])
            if epoch.as_py() < EPOCHS:
                leader.step(found, x, label)
            else:
                logits.append(x @ leader.weights(found) + leader.weights(slice(-1, None))[0])
                labels.append(label)
    w = leader.weights(slice(None))
    feature, label = np.nonzero(w)
    weight = w[feature, label]
    feature = np.where(feature == len(w) - 1, -1, feature)
    t = fit_temperature(np.array(logits), np.array(labels, np.int64))
    columns = [pa.array(np.append(feature, -2), pa.int32()), pa.array(np.append(label, 0), pa.int32()), pa.array(np.append(weight, t), pa.float64())]
    yield pa.RecordBatch.from_arrays(columns, ["feature", "label", "weight"])


def fit(documents: DataFrame, learns: Column | None = None, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from the rows of (doc_id, text, lang) where `learns` holds and lang is not null.

    Document frequencies count all such rows with a letter. The sample takes the rows with the smallest hash of the doc_id in each
    of the max_languages languages that have most rows. Texts without a letter teach nothing. Without a row no language is learned.
    """
    spark = documents.sparkSession
    small_arrow_batches(spark)
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (F.lit(True) if learns is None else learns).alias("learns"))
    rows = rows.where("learns and lang is not null and text is not null").select("doc_id", "text", "lang")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    share = {r["lang"]: min(1.0, 2 * per_language / r["n"]) for r in totals}
    blank = Model([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    if not share:
        return blank

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found, _ = gram_counts(text.as_py())
                df[found] += 1
                n += len(found) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["t", "n"])

    counted = rows.select("text").mapInArrow(count, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()  # 2^BITS rows
    counts = {r["t"]: r["n"] for r in counted}
    total = counts.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    # A hash below twice the wanted share leaves little to rank, also of a language that holds most rows.
    draw = F.xxhash64("doc_id", F.lit(13))
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    near = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * F.lit(1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw", "doc_id"))
    sample = near.withColumn("place", place).where(F.col("place") <= per_language)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gram_counts(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), *lists], ["lang", "draw", "found", "counts"])

    coded = sample.select("text", "lang", "draw").mapInArrow(encode, "lang string, draw long, found array<int>, counts array<int>").where(F.size("found") > 0)
    coded = stored(coded, "language-sample")
    languages = sorted(r["lang"] for r in coded.select("lang").distinct().collect())
    if not languages:
        return blank
    labels = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    back = F.pmod(F.xxhash64("draw", F.lit(1)), F.lit(KEPT_BACK)) == 0
    epochs = F.when(back, F.array(F.lit(EPOCHS))).otherwise(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    stream = coded.select(F.explode(epochs).alias("epoch"), F.element_at(labels, F.col("lang")).alias("label"), "draw", "found", "counts")
    stream = stream.repartition(1).sortWithinPartitions("epoch", F.xxhash64("draw", "epoch"), "draw").select("epoch", "label", "found", "counts")
    learned = stream.mapInArrow(lambda batches: learn(batches, idf, len(languages)), "feature int, label int, weight double").toArrow()
    feature, label, weight = (learned.column(c).to_numpy() for c in ("feature", "label", "weight"))
    model = Model(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
    model.weights[feature[feature >= 0], label[feature >= 0]] = weight[feature >= 0]
    model.bias[label[feature == -1]] = weight[feature == -1]
    model.temperature = float(weight[feature == -2][0])
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred string and score double; columns of these names are replaced.

    Only the text is read. A null text, or one without a letter, is `und` with score 0, and so is every text if no language was
    learned. Texts of any length are read whole, in pieces. Repeated rows get the same answer; an empty table stays empty.
    """
    small_arrow_batches(documents.sparkSession)
    rest = documents.drop("lang_pred", "score")
    schema = StructType([*rest.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.judge(t.as_py()) for t in batch.column("text")]
            new = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(judge, schema)
