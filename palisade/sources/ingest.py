"""Which reader a location needs, and archives as part of an inventory."""

from __future__ import annotations

import pathlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.sources.archives import ArchiveLimits, expand_archives, members_as_files
from palisade.sources.files import ARCHIVE_EXTS, declared_ext, prepare_files, read_file, read_tree


def source_type(spark: SparkSession, location: str) -> str:
    """archive, file or directory: a file by its suffix, whatever else there is or is not is a directory."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path) or system.getFileStatus(path).isDirectory():
        return "directory"
    return "archive" if pathlib.PurePosixPath(location).suffix.lower() in ARCHIVE_EXTS else "file"


def ingest(spark: SparkSession, location: str, repo_id: str | None = None, limits: ArchiveLimits | None = None) -> DataFrame:
    """The inventory of a location, with bytes and its ``source_type``.

    A directory gives its files (archives in it stay files, see ``with_members``), an archive its members, a file itself.
    Without ``repo_id`` a directory's first path segments name the repositories, and anything else is named after itself.
    """
    kind = source_type(spark, location)
    if kind == "directory":
        files = read_tree(spark, location, repo_id)
    else:
        name = repo_id or pathlib.PurePosixPath(location).name
        files = read_file(spark, location, name)
        if kind == "archive":
            files = expand_archives(files, limits).select("repo_id", "path", "size", "raw", F.lit(None).cast("timestamp").alias("mtime"))
    return files.select("repo_id", "path", "size", "raw", "mtime", F.lit(kind).alias("source_type"))


def ingest_all(spark: SparkSession, locations: list[str], limits: ArchiveLimits | None = None) -> DataFrame:
    """One inventory of several locations, each by its own reader."""
    parts = [ingest(spark, location, limits=limits) for location in locations]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def is_archive(files: DataFrame) -> DataFrame:
    return files.where(declared_ext(F.col("path")).isin(*ARCHIVE_EXTS))


def archive_members(files: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    """Prepared files for the members of the archives among ``files``, in repositories named "repo!archive"."""
    archives = is_archive(files).where("raw is not null").select("repo_id", "path", "raw")
    return prepare_files(members_as_files(expand_archives(archives, limits)))


def with_members(inventory: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    """An inventory in which the members of its archives stand beside the files; the archives stay, with their own bytes."""
    members = members_as_files(expand_archives(is_archive(inventory).where("raw is not null"), limits))
    return inventory.select("repo_id", "path", "size", "raw").unionByName(members)


