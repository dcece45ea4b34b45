"""A directory tree as a stream, hidden names, changes and deletions included.

Spark's own file source skips names that start with a dot or an underscore, and never sees a file again or gone. Here tasks list
the tree; what differs from what was published before goes, as numbered entries, to a log of Parquet files, and that log is what is
streamed. So the source's offsets are the listings themselves: they live beside the checkpoint, survive restarts, and are compared
as tables, never in the driver. Files are opened by the tasks that read the entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.operators.history import read_or_empty
from palisade.sources.files import filter_ignored, list_tree

ENTRY = "repo_id string, path string, size long, mtime timestamp, location string, gone boolean, tick long"


def newest_entries(entries: DataFrame) -> DataFrame:
    """The last entry of each file; entries of a file combine before the shuffle."""
    rest = [c.split()[0] for c in ENTRY.split(", ") if c.split()[0] not in ("repo_id", "path", "tick")]
    last = F.max_by(F.struct(*rest, "tick"), "tick").alias("e")
    return entries.groupBy("repo_id", "path").agg(last).select("repo_id", "path", "e.*")


def publish_listing(spark: SparkSession, root: str, log: str, repo_id: str | None = None) -> int:
    """Append an entry for each file that is new, changed (size or time) or gone since the last listing; returns their number.

    A publication that is cut off half-way leaves entries that are true; the next one adds the rest.
    """
    published = read_or_empty(spark, log, ENTRY)
    tick = (published.agg(F.max("tick")).first()[0] or 0) + 1
    known = newest_entries(published).where("not gone")
    listed = filter_ignored(list_tree(spark, root, repo_id, skip_ignored=True))
    now = listed.select("repo_id", "path", F.struct("size", "mtime", "location").alias("now"))
    before = known.select("repo_id", "path", F.struct("size", "mtime", "location").alias("before"))
    changed = now.join(before, ["repo_id", "path"], "full_outer").where(
        "now is null or before is null or now.size <> before.size or not (now.mtime <=> before.mtime)"
    )
    entry = F.coalesce("now", "before")
    rows = changed.select("repo_id", "path", entry["size"].alias("size"), entry["mtime"].alias("mtime"), entry["location"].alias("location"), F.col("now").isNull().alias("gone"), F.lit(tick).cast("long").alias("tick"))
    rows.write.mode("append").parquet(log)
    return spark.read.schema(ENTRY).parquet(log).where(F.col("tick") == tick).count()


def entry_stream(spark: SparkSession, log: str) -> DataFrame:
    """The published entries as a stream."""
    return spark.readStream.schema(ENTRY).parquet(log)
