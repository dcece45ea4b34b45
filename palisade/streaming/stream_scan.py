"""Scanning as files arrive.

Detectors are stateless per file, so each micro-batch runs the batch code. A batch is written to a directory of its own
number with overwrite: a retried batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.plans.scan import scan
from palisade.sources.files import prepare_files, read_raw
from palisade.sources.tables import spread
from palisade.sources.watch import entry_stream, newest_entries, publish_listing


def stream_scan(files: DataFrame, out: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame] = scan,
                available_now: bool = True) -> StreamingQuery:
    """Start scanning a streaming files DataFrame into ``out``/batch=N."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _scan_batch(spread(batch), batch_id, out, checkpoint, detect)

    return _start(files, write, checkpoint, available_now)


def _scan_batch(files: DataFrame, batch_id: int, out: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    # The batch is stored first: every branch of a scan would otherwise read and decode the source again.
    kept = f"{checkpoint}/files/batch={batch_id}"
    files.write.mode("overwrite").parquet(kept)
    detect(files.sparkSession.read.parquet(kept)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_tree(spark: SparkSession, root: str, out: str, checkpoint: str, repo_id: str | None,
                detect: Callable[[DataFrame], DataFrame] = scan) -> StreamingQuery:
    """List a directory tree, then scan what is new, changed or gone since the last call with this checkpoint.

    Hidden names count. ``tree_findings`` gives what the scan of the tree as it was listed last would give; call this again, after a
    restart too, to follow the tree.
    """
    log = f"{checkpoint}/entries"
    publish_listing(spark, root, log, repo_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch may hold several listings.
        newest = f"{checkpoint}/newest/batch={batch_id}"
        newest_entries(batch).write.mode("overwrite").parquet(newest)
        entries = spark.read.parquet(newest)
        _scan_batch(prepare_files(read_raw(entries.where("not gone"))), batch_id, out, checkpoint, detect)

    return _start(entry_stream(spark, log), write, f"{checkpoint}/query", True)


def streamed_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of all batches."""
    return spark.read.parquet(out).drop("batch")


def tree_findings(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """Findings of a streamed tree: each file's from the batch that saw it last, none of files that are gone."""
    entries = spark.read.parquet(f"{checkpoint}/newest")
    last = entries.groupBy("repo_id", "path").agg(F.max_by(F.struct("gone", "batch"), "batch").alias("e"))
    alive = last.where("not e.gone").select("repo_id", "path", F.col("e.batch").alias("batch"))
    return spark.read.parquet(out).join(alive, ["repo_id", "path", "batch"], "left_semi").drop("batch")
