"""Corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

toxicity rejects documents, the n-gram join keeps one document of each group of near copies, personal data is replaced, and the
rest is packed into token sequences. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import ngram_join, packing, surrogates, toxicity
from palisade.llm.common import stored
from palisade.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the examples are the labelled ones among docs."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.drop_near_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates; n_chars follows the new text, a null text keeps its number."""
    changed = surrogates.replace_entities(docs)
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in the sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]
#: Learned scores and keyed surrogates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
