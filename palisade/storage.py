"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; without one, a folder in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/palisade-scratch").rstrip("/")


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for one run."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
