"""Text tables seen as files: one row, one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.sources.files import with_flags


def spread(rows: DataFrame) -> DataFrame:
    """Redistribute an input that splits into far fewer partitions than there are cores.

    A scan cannot be split below a parquet row group, and regular expressions make each row expensive. Inputs of normal
    size have more splits than cores and are left as they are, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def read_texts(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns))


def text_as_file(rows: DataFrame, repo_id: Column, path: Column, content: Column) -> DataFrame:
    files = rows.select(repo_id.alias("repo_id"), path.alias("path"), content.alias("content"))
    return with_flags(files.withColumn("size", F.octet_length("content").cast("long")))


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return text_as_file(docs, F.col("source"), path, F.col("text"))


def pages_as_files(spark: SparkSession, sf_dir: str, suffix: str = ".html") -> DataFrame:
    pages = read_texts(spark, sf_dir, "pages", "page_id", "url", "html")
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(suffix))
    return text_as_file(pages, host, path, F.col("html"))


def conversations_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    path = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md"))
    return text_as_file(turns, F.col("role"), path, F.col("text"))


def corpus_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three text tables as one inventory."""
    return (
        documents_as_files(spark, sf_dir)
        .unionByName(pages_as_files(spark, sf_dir))
        .unionByName(conversations_as_files(spark, sf_dir))
    )
