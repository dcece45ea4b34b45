"""Scan history as tables: scans, scan_tags, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values.
REDACTED = "<redacted>"
HISTORY_CUT = 120
RECENT = 5


def redact(findings: DataFrame) -> DataFrame:
    """Payload columns are masked and texts cut before findings are kept."""
    def masked(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.lit(REDACTED))

    def cut(name: str) -> Column:
        return F.when(
            F.length(name) > HISTORY_CUT, F.concat(F.left(name, F.lit(HISTORY_CUT)), F.lit("..."))
        ).otherwise(F.col(name))

    return findings.withColumns(
        {"raw_value": masked("raw_value"), "decoded": masked("decoded"), "snippet": cut("snippet"), "description": cut("description")}
    )


def scan_rows(risk: DataFrame, scan_time: Column, files_count: DataFrame, duration_ms: Column | None = None) -> DataFrame:
    """One history row per repository of a run; the id is a digest of repository and time, so a rerun repeats it."""
    counted = risk.join(files_count.select("repo_id", F.col("total_files").alias("files_count")), "repo_id", "left")
    return counted.select(
        F.sha2(F.concat_ws("|", "repo_id", scan_time.cast("string")), 256).alias("scan_id"),
        "repo_id",
        scan_time.alias("scan_time"),
        F.to_date(scan_time).alias("scan_date"),
        (duration_ms if duration_ms is not None else F.lit(None)).cast("long").alias("duration_ms"),
        F.coalesce("files_count", F.lit(0)).cast("long").alias("files_count"),
        "score", "max_severity", "critical", "high", "medium", "low", "total",
    )


def tag_rows(scans: DataFrame, tags: Column) -> DataFrame:
    return scans.select("scan_id", F.explode(tags).alias("tag"))


def write_version(rows: DataFrame, path: str) -> None:
    """Write a table as the next version of a folder of versions; ``current`` reads the newest complete one.

    Spark cannot overwrite what it reads. A reader of the version before is not disturbed, and a failed write leaves no newer
    version behind, since it lacks its mark.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/version={next_version(spark, path)}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a stored table; listed through the file system that Spark uses for the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().removeprefix("version=")) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))


def next_version(spark: SparkSession, path: str) -> int:
    return max(versions(spark, path), default=0) + 1


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a stored table; None before the first."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/version={known[-1]}") if known else None


# One row a committed run. A run's tables are written under its own names first; its row comes last.
COMMITS = "run long, run_key string, scan_time timestamp, rules_version string, duration_ms long"


def committed_runs(spark: SparkSession, out: str) -> DataFrame:
    """Runs whose tables are complete. Whatever else lies under ``out`` belongs to a run that was cut off, and no reader sees it."""
    return read_or_empty(spark, f"{out}/commits", COMMITS)


def commit_run(spark: SparkSession, out: str, run: int, run_key: str, scan_time: Column, rules_version: str, duration_ms: int) -> None:
    """The one write that makes a run visible: a single file that appears whole under its name."""
    row = spark.range(1, numPartitions=1).select(
        F.lit(run_key).alias("run_key"), scan_time.alias("scan_time"), F.lit(rules_version).alias("rules_version"),
        F.lit(duration_ms).cast("long").alias("duration_ms"),
    )
    row.write.mode("overwrite").parquet(f"{out}/commits/run={run}")


def write_run_part(rows: DataFrame, path: str, run_key: str, *partitions: str) -> None:
    """A run's share of a growing table, in directories of its own key: a repeated run replaces its share and nothing else."""
    keyed = rows.withColumn("run_key", F.lit(run_key))
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions, "run_key").parquet(path)


def of_committed_runs(spark: SparkSession, out: str, table: str, schema: str) -> DataFrame:
    """Rows of a growing table that belong to committed runs."""
    rows = read_or_empty(spark, f"{out}/{table}", f"{schema}, run_key string")
    return rows.join(committed_runs(spark, out).select("run_key"), "run_key", "left_semi").drop("run_key")


SCANS = (
    "scan_id string, repo_id string, scan_time timestamp, duration_ms long, files_count long, score double, "
    "max_severity string, critical long, high long, medium long, low long, total long, scan_date date"
)
TAGS = "scan_id string, tag string"


def append_scans(scans: DataFrame, path: str) -> None:
    """Append, one directory per scan date. Overwriting only the touched dates would drop other runs of the day."""
    scans.write.mode("append").partitionBy("scan_date").parquet(path)


def list_scans(scans: DataFrame, limit: int = 50, offset: int = 0, tag: str | None = None, tags: DataFrame | None = None,
               max_severity: str | None = None) -> DataFrame:
    """Newest first; a tag keeps each scan once, however often it carries it."""
    kept = scans
    if tag:
        kept = kept.join(tags.where(F.col("tag") == tag), "scan_id", "left_semi")
    if max_severity:
        kept = kept.where(F.col("max_severity") == max_severity)
    return kept.orderBy(F.col("scan_time").desc(), "scan_id").offset(offset).limit(limit)


def scan_dates(spark: SparkSession, path: str) -> list[str]:
    """Date directories of a stored scans table, newest first; names only, no file is opened."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted((n.removeprefix("scan_date=") for n in names if n.startswith("scan_date=")), reverse=True)


def page_of_scans(spark: SparkSession, path: str, limit: int = 50, offset: int = 0, tag: str | None = None,
                  tags: DataFrame | None = None, max_severity: str | None = None) -> DataFrame:
    """``list_scans`` over a stored history, by date from the newest on: twice as many days each time, until the page is full.

    scan_date must be the date of scan_time, or a time span that grows with it. Only the directories of these days are read.
    """
    dates = scan_dates(spark, path)
    if not dates:
        raise ValueError(f"no scans under {path}")
    days = 1
    while True:
        recent = spark.read.parquet(path).where(F.col("scan_date") >= F.lit(dates[min(days, len(dates)) - 1]).cast("date"))
        page = list_scans(recent, limit, offset, tag, tags, max_severity)
        if days >= len(dates) or list_scans(recent, limit + offset, 0, tag, tags, max_severity).count() == limit + offset:
            return page
        days *= 2


def scan_by_id(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.where(F.col("scan_id") == scan_id)


def delete_scans(scans: DataFrame, tags: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the scans listed in ``doomed``."""
    ids = doomed.select("scan_id")
    return scans.join(ids, "scan_id", "left_anti"), tags.join(ids, "scan_id", "left_anti")


def scan_totals(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_risk_score"),
    )


def worst_scan(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.col("score").desc(), F.col("scan_time").desc(), "scan_id").limit(1)


def recent_scans(scans: DataFrame, n: int = RECENT) -> DataFrame:
    return scans.orderBy(F.col("scan_time").desc(), "scan_id").limit(n)
