"""Shared folder, stored intermediate tables, row keys and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_palisade_folder"):
        spark.sparkContext._palisade_folder = "file://" + tempfile.mkdtemp(prefix="palisade-llm-")
    return spark.sparkContext._palisade_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later stages survive lost executors and never redo the work."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_arrow_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set(ARROW_BYTES, size)


def release_memory() -> None:
    """At the start of a task: give back what earlier tasks of a reused Python worker left behind, such as their models.

    In the driver: give back what making a model took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_key(text: Column | str) -> Column:
    """128 bits of a text as two longs; a null text has a key too."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shard_count(rows: int, per_shard: int, least: int = 1) -> int:
    return max(least, -(-rows // per_shard))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node it reaches.

    Each round every node, and the node its label names, take the smallest label that the labels of its neighbours have, then
    every node its label's own label. Hooking the named node too makes a long chain settle in a few rounds, where passing labels
    on alone takes as many as the chain is long. Labels are aggregates that combine before the shuffle, and are stored each round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        named = labels.join(labels.select(F.col("u").alias("c"), F.col("c").alias("g")), "c")
        seen = both.join(named.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("n"))
        own = F.struct("u", F.least("g", "n").alias("c"), F.col("c").alias("old"))
        hook = F.struct(F.col("c").alias("u"), F.col("n").alias("c"), F.lit(None).cast(labels.schema["c"].dataType).alias("old"))
        taken = named.join(seen, "u").select(F.inline(F.array(own, hook)))
        labels = stored(taken.groupBy("u").agg(F.min("c").alias("c"), F.max("old").alias("old")), "labels")
        if not labels.where("c != old").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = labels.select("u", "c")


