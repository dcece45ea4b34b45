"""Unchanged files leave a stream of file versions: what was scanned last is keyed state that timers let go.

The state of a file is one small row (hash, size, rules, time), so it is bounded by the files seen within the time to live, whatever
the stream's length. Needs the RocksDB state store, which ``start_changed`` sets for its session.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "repo_id string, path string, size long, sha256 string, at long"


class LastSeen(StatefulProcessor):
    """Emits a file's version unless the version before it, seen at most ``ttl`` earlier under the same rules, was equal.

    Times are microseconds.
    """

    def __init__(self, rules_version: str, ttl: timedelta):
        self.rules_version, self.ttl = rules_version, ttl // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "size long, sha256 string, rules string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        versions = [(r["at"], r["size"], r["sha256"]) for r in rows]
        versions.sort(key=lambda v: (v[0], v[1] is None, v[1] or 0, v[2] is None, v[2] or ""))
        last = before = self.last.get()
        kept = []
        for at, size, sha256 in versions:
            known = last is not None and last[2] == self.rules_version and last[0] == size and last[1] == sha256
            if not known or at - last[3] > self.ttl:
                kept.append(Row(repo_id=key[0], path=key[1], size=size, sha256=sha256, at=at))
            # A late row does not set the clock back.
            last = (size, sha256, self.rules_version, at if last is None else max(at, last[3]))
        self.last.update(last)
        # A file has one timer, at a place that its state tells.
        if before is None or self._ends(before) != self._ends(last):
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(last))
        yield from kept

    def _ends(self, last: tuple) -> int:
        """When the file's state is let go, in milliseconds."""
        return (last[3] + self.ttl) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.last.clear()
        yield from ()


def changed_versions(versions: DataFrame, rules_version: str, ttl: timedelta, late: str = "1 hour") -> DataFrame:
    """A stream of file versions (repo_id, path, size, sha256, seen) without those that repeat the file's last one.

    Two missing sizes or hashes count as equal. A version counts again if its file was not seen for longer than ``ttl``, or was scanned under other rules. Versions of a
    file are taken in the order of ``seen``; rows later than the watermark allows (``late``) are not looked at.
    """
    slim = versions.select("repo_id", "path", F.col("size").cast("long").alias("size"), "sha256", "seen", F.unix_micros("seen").alias("at"))
    keyed = slim.withWatermark("seen", late).groupBy("repo_id", "path")
    changed = keyed.transformWithState(LastSeen(rules_version, ttl), OUT, "append", "EventTime")
    return changed.withColumn("seen", F.timestamp_micros("at")).drop("at")


def start_changed(spark: SparkSession, versions: DataFrame, out: str, checkpoint: str, rules_version: str, ttl: timedelta, late: str = "1 hour") -> StreamingQuery:
    """Run ``changed_versions`` over what is there into a Parquet sink; returns the query."""
    spark.conf.set(PROVIDER, ROCKS)
    changed = changed_versions(versions, rules_version, ttl, late)
    writer = changed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
