"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palisade.storage import run_folder

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``big`` joined with ``small`` on ``keys``; rows of one key spread over ``salts`` parts, each with its copy of the small side.

    The salt hashes the other plain columns, so it is the same when a task is repeated. For inner, left and left_semi joins.
    """
    plain = [F.col(c) for c, kind in big.dtypes if c not in keys and not any(x in kind for x in ("map", "variant"))]
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts)) if plain else F.lit(0).cast("long")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number, from 1, within ``keys`` by ``order``.

    The table is sorted into ranges that cut through large keys; rows are numbered within a range, and a range's rows of a key
    start behind those of the ranges before it. So no task holds a key as a whole. The ranges are a table in the shared folder.
    """
    spark, folder = rows.sparkSession, run_folder(rows.sparkSession, "ranges")
    rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    ranged = spark.read.parquet(folder)
    sizes = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts.withColumnRenamed("_range", "_r"), same).select(*rows.columns, (F.col("_place") + F.col("_start")).alias(name))
