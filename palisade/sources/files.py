"""File inventory: listing, ignore rules, type flags, decoding."""

from __future__ import annotations

import math
import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import file_name
from palisade.storage import run_folder

# Directories and extensions that an inventory leaves out.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv",
    "env", ".vscode", ".idea", "dist", "build", "target",
    "vendor", ".next", ".nuxt", ".cache",
)
IGNORED_EXTS = (
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib",
    ".woff", ".woff2", ".ttf", ".eot",
    ".bin", ".o", ".a", ".lib", ".obj",
    ".map",
)
# Extension groups.
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".webp")
ARCHIVE_EXTS = (".zip", ".tar", ".gz", ".tgz", ".rar", ".7z")
SCRIPT_EXTS = (".js", ".jsx", ".ts", ".tsx", ".py", ".sh", ".bash", ".ps1", ".bat", ".vbs", ".cmd")
CONFIG_EXTS = (".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".cfg")
# MIME type by extension.
MIME_TYPES = {
    ".svg": "image/svg+xml", ".xml": "application/xml", ".html": "text/html", ".htm": "text/html",
    ".js": "text/javascript", ".jsx": "text/javascript", ".ts": "text/typescript", ".tsx": "text/typescript",
    ".json": "application/json", ".yaml": "text/yaml", ".yml": "text/yaml", ".md": "text/markdown",
    ".txt": "text/plain", ".sh": "text/x-shellscript", ".bash": "text/x-shellscript", ".ps1": "text/powershell",
    ".bat": "text/bat", ".py": "text/x-python", ".rb": "text/x-ruby", ".php": "text/x-php", ".css": "text/css",
    ".scss": "text/scss", ".less": "text/less", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".gif": "image/gif", ".ico": "image/x-icon", ".woff": "font/woff", ".woff2": "font/woff2", ".ttf": "font/ttf",
    ".eot": "font/eot", ".pdf": "application/pdf", ".zip": "application/zip", ".tar": "application/x-tar",
    ".gz": "application/gzip", ".exe": "application/x-msdownload", ".dll": "application/x-msdownload",
}
UNKNOWN_MIME = "application/octet-stream"
# Content signatures.
SVG_HEADS = ("<svg", "<SVG")
SVG_NAMESPACE = 'xmlns="http://www.w3.org/2000/svg"'
SCRIPT_HEADS = (
    "#!/usr/bin/env", "#!/bin/sh", "#!/bin/bash", "#!/usr/bin/python",
    "<script", "function ", "const ", "let ", "var ",
    "require(", "import ", "export ",
)
TEXT_MIMES = ("application/json", "application/xml", "image/svg+xml", "text/javascript", "text/typescript")


#: Bytes of a range of one large file.
RANGE_BYTES = 16 * 1024 * 1024

_LISTING = "kind string, path string, size long, modified double, location string"


def _local_root(root: str) -> str | None:
    """The directory behind a plain path or file: address; None for other file systems."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return None if "://" in root else os.path.abspath(root)


def _entries(directory: str) -> Iterator[tuple[str, str, int | None, float | None, str]]:
    """(kind, name, size, mtime, location) of what one directory holds, dot and underscore names included.

    On local file systems symbolic links are neither followed nor listed.
    """
    if "://" not in directory:
        for entry in os.scandir(directory):
            status = entry.stat(follow_symlinks=False)
            if stat.S_ISDIR(status.st_mode):
                yield "dir", entry.name, None, None, entry.path
            elif stat.S_ISREG(status.st_mode):
                yield "file", entry.name, status.st_size, status.st_mtime, entry.path
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(directory)
    for info in system.get_file_info(fs.FileSelector(path)):
        kind = {fs.FileType.Directory: "dir", fs.FileType.File: "file"}.get(info.type)
        if kind:
            modified = info.mtime.timestamp() if info.mtime else None
            yield kind, info.base_name, info.size, modified, f"{directory.rstrip('/')}/{info.base_name}"


def list_tree(spark: SparkSession, root: str, repo_id: str | None = None, skip_ignored: bool = False) -> DataFrame:
    """Recursive listing: repo_id, path relative to the root, size, mtime, location. No file is opened.

    Works for mounted directories and for addresses that Arrow's file systems know. Tasks list single directories, level by
    level, so neither a wide nor a deep tree is one task's work; each level is a table in the shared folder. Names that start with
    a dot or an underscore count (pipelines and environment files do). A directory that cannot be listed gives an error row
    (``listing_errors``). With ``repo_id`` None the first path segment names the repository.
    """
    return _with_repo(_walked(spark, root, skip_ignored).where("kind = 'file'"), repo_id).select(
        "repo_id", "path", "size", F.timestamp_seconds("modified").alias("mtime"), "location"
    )


def listing_errors(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """An error row for each directory that cannot be listed."""
    return _with_repo(_walked(spark, root, False).where("kind = 'error'"), repo_id).select(
        "repo_id", "path", F.lit("listing").alias("stage"), F.lit("the directory could not be listed").alias("reason")
    )


def _walked(spark: SparkSession, root: str, skip_ignored: bool) -> DataFrame:
    base = _local_root(root) or root.rstrip("/")
    out = run_folder(spark, "listing")
    skipped = frozenset(IGNORED_DIRS) if skip_ignored else frozenset()

    def list_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "path", "size", "modified", "location"]
        for batch in batches:
            for directory, inside in zip(batch["location"], batch["path"]):
                rows = []
                try:
                    for kind, name, size, modified, location in _entries(directory):
                        if kind == "file" or name not in skipped:
                            rows.append((kind, f"{inside}/{name}" if inside else name, size, modified, location))
                except OSError:
                    rows.append(("error", inside, None, None, directory))
                yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    open_ = spark.createDataFrame([(base, "")], "location string, path string")
    level = 0
    while True:
        listed = open_.repartition(4 * spark.sparkContext.defaultParallelism, "location") if level else open_
        listed.mapInPandas(list_some, _LISTING).write.parquet(f"{out}/level={level}")
        open_ = spark.read.schema(_LISTING).parquet(f"{out}/level={level}").where("kind = 'dir'").select("location", "path")
        if not open_.limit(1).count():
            return spark.read.schema(_LISTING).option("basePath", out).parquet(out).select("kind", "path", "size", "modified", "location")
        level += 1


def _with_repo(listing: DataFrame, repo_id: str | None) -> DataFrame:
    if repo_id is not None:
        return listing.withColumn("repo_id", F.lit(repo_id))
    return listing.withColumns(
        {"repo_id": F.substring_index("path", "/", 1), "path": F.regexp_replace("path", r"^[^/]*/", "")}
    )


def read_raw(listing: DataFrame, max_size_mb: float | None = None) -> DataFrame:
    """Open the listed files in tasks and add their bytes; files above a limit, and unreadable ones, keep null.

    The listing is spread by name first, so a directory that holds most files is read by all tasks.
    """
    limit = math.inf if max_size_mb is None else int(max_size_mb * 1024 * 1024)
    tasks = 4 * listing.sparkSession.sparkContext.defaultParallelism
    plain = listing.select("repo_id", "path", "size", "mtime", "location").repartition(tasks, "repo_id", "path")
    schema = "repo_id string, path string, size long, mtime timestamp, location string, raw binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A few files at a time, so that a batch of large ones does not fill the worker.
            for start in range(0, len(batch), 64):
                part = batch.iloc[start:start + 64].copy()
                part["raw"] = [_read_bytes(p) if n <= limit else None for p, n in zip(part["location"], part["size"])]
                yield part

    return plain.mapInPandas(run, schema).drop("location")


def _read_bytes(location: str) -> bytes | None:
    try:
        if "://" not in location:
            with open(location, "rb") as f:
                return f.read()
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(location)
        with system.open_input_file(path) as f:
            return f.read()
    except OSError:
        return None


def read_tree(spark: SparkSession, root: str, repo_id: str | None = None, max_size_mb: float | None = None) -> DataFrame:
    """Inventory with bytes of a directory tree, mounted or remote. The ignore rules apply before anything is opened."""
    return read_raw(filter_ignored(list_tree(spark, root, repo_id, skip_ignored=True)), max_size_mb)


def read_remote_tree(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """The same over file systems that only Spark knows; ``read_tree`` is complete wherever Arrow knows the address.

    Spark's own listing skips names that start with a dot or an underscore.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare_root = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "", root).rstrip("/")
    relative = F.substring_index("path", bare_root + "/", -1)
    named = listing.select(
        relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("raw")
    )
    return _with_repo(named, repo_id).select("repo_id", "path", "size", "raw", "mtime")


def read_file(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """One file as a one-row inventory, under its own name."""
    listing = spark.read.format("binaryFile").load(path)
    return listing.select(
        F.lit(repo_id).alias("repo_id"),
        file_name(F.col("path")).alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("raw"),
        F.col("modificationTime").alias("mtime"),
    )


def read_ranges(spark: SparkSession, path: str, repo_id: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(repo_id, path, size, at, start, raw) of one file of any size: its ranges in order, each opened by a task, so no cell holds the file.

    Works for mounted files and addresses that Arrow's file systems know; an empty file has no range. A file that shrinks
    while it is read ends the job, as a part of it would be missing.
    """
    listing = spark.read.format("binaryFile").load(path)
    last = F.ceil(F.col("length") / range_bytes).cast("long") - 1
    parts = listing.where("length > 0").select(F.col("path").alias("location"), file_name(F.col("path")).alias("path"), F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    spread = parts.repartition(4 * spark.sparkContext.defaultParallelism, "path", "at").select("location", "path", "size", "at", (F.col("at") * range_bytes).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.iloc[i:i + 1].copy()
                start, size = int(one["start"].iat[0]), int(one["size"].iat[0])
                wanted = min(range_bytes, size - start)
                raw = _read_range(one["location"].iat[0], start, wanted)
                if len(raw) != wanted:
                    raise OSError(f"{one['location'].iat[0]} is shorter than it was")
                yield one.assign(raw=[raw])

    schema = "location string, path string, size long, at long, start long, raw binary"
    return spread.mapInPandas(run, schema).select(F.lit(repo_id).alias("repo_id"), "path", "size", "at", "start", "raw")


def _read_range(location: str, start: int, length: int) -> bytes:
    local = _local_root(location)
    if local is not None:
        with open(local, "rb") as f:
            f.seek(start)
            return f.read(length)
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(location)
    with system.open_input_file(inside) as f:
        f.seek(start)
        return f.read(length)


def source_kind(path: Column) -> Column:
    """Which reader a listed path needs: archive, or file."""
    return F.when(declared_ext(path).isin(*ARCHIVE_EXTS), "archive").otherwise("file")


def declared_ext(path: Column) -> Column:
    """Lower-cased suffix of the file name; a leading dot alone does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def _in_ignored_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))


def filter_ignored(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Without ignored directories and suffixes; files above ``max_bytes`` go only where a limit is given (see ``left_out``)."""
    wanted = ~_in_ignored_dir(F.col("path")) & ~declared_ext(F.col("path")).isin(*IGNORED_EXTS)
    return files.where(wanted if max_bytes is None else wanted & (F.col("size") <= max_bytes))


def left_out(files: DataFrame, max_bytes: int, stage: str = "inventory") -> DataFrame:
    """An error row for each file above a limit."""
    reason = F.concat(F.col("size").cast("string"), F.lit(f" bytes, more than {max_bytes}"))
    return files.where(F.col("size") > max_bytes).select("repo_id", "path", F.lit(stage).alias("stage"), reason.alias("reason"))


def unreadable(files: DataFrame, raw: str = "raw") -> DataFrame:
    """An error row for each file whose bytes could not be read."""
    return files.where(F.col(raw).isNull()).select(
        "repo_id", "path", F.lit("read").alias("stage"), F.lit("the bytes could not be read").alias("reason")
    )


def filter_unsafe_names(members: DataFrame, name: str = "path") -> DataFrame:
    """Archive names that could leave the extraction directory, plus the ignore rules."""
    value = F.col(name)
    return members.where(
        ~F.array_contains(F.split(value, "/"), "..")
        & ~F.startswith(value, F.lit("/"))
        & ~F.contains(value, F.lit(":"))
        & ~_in_ignored_dir(value)
        & ~declared_ext(value).isin(*IGNORED_EXTS)
    )


def guess_mime(path: Column) -> Column:
    pairs = [F.lit(x) for item in MIME_TYPES.items() for x in item]
    suffix = F.regexp_extract(F.lower(path), r"\.[^./]*$", 0)
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix), F.lit(UNKNOWN_MIME))


def _ends_with_any(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.regexp_extract(F.lower(path), r"\.[^./]*$", 0).isin(*suffixes)


def with_mime(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {"declared_ext": declared_ext(F.col("path")), "detected_mime": guess_mime(F.col("path"))}
    )


def with_flags(files: DataFrame, text_mode: str = "name") -> DataFrame:
    """Type flags by name. JSON, SVG, TOML and most source languages do not count as text.

    ``text_mode="sniff"`` also takes textual MIME types, and files whose first bytes look like a script, for text; it
    needs ``raw``.
    """
    if text_mode not in ("name", "sniff"):
        raise ValueError(f"text_mode must be name or sniff, got {text_mode!r}")
    if text_mode == "sniff":
        wide = with_sniffed_type(with_flags(files))
        textual = F.col("is_text") | F.col("sniffed_text") | F.coalesce("sniffed_script", F.lit(False))
        return wide.withColumn("is_text", textual).drop("sniffed_svg", "sniffed_script", "sniffed_text")
    path = F.col("path")
    return with_mime(files).withColumns(
        {
            "is_text": F.contains(F.col("detected_mime"), F.lit("text")),
            "is_svg": F.endswith(F.lower(path), F.lit(".svg")),
            "is_script": _ends_with_any(path, SCRIPT_EXTS),
            "is_config": _ends_with_any(path, CONFIG_EXTS),
        }
    )


def is_text_mime(mime: Column) -> Column:
    return F.startswith(mime, F.lit("text/")) | mime.isin(*TEXT_MIMES)


def latin_head(raw: Column, n_bytes: int) -> Column:
    """First bytes, one character per byte."""
    return F.decode(F.substring(raw, 1, n_bytes), "ISO-8859-1")


def with_sniffed_type(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Types by content: SVG and script markers near the start of the bytes."""
    head = latin_head(F.col(raw), 200)
    low = F.lower(head)
    svg = F.contains(latin_head(F.col(raw), 500), F.lit(SVG_NAMESPACE))
    for mark in SVG_HEADS:
        svg = svg | F.contains(head, F.lit(mark))
    script = F.lit(False)
    for mark in SCRIPT_HEADS:
        script = script | F.contains(low, F.lit(mark))
    return files.withColumns(
        {"sniffed_svg": svg, "sniffed_script": script, "sniffed_text": is_text_mime(F.col("detected_mime"))}
    )


def with_content(files: DataFrame, max_size_mb: float | None = None) -> DataFrame:
    """Decode and hash every file. Above a limit, where one is given, raw and content are null; the hash is always taken."""
    fits = F.lit(True) if max_size_mb is None else F.col("size") <= int(max_size_mb * 1024 * 1024)
    return files.withColumns(
        {
            "sha256": F.sha2("raw", 256),
            "content": F.when(fits, F.make_valid_utf8(F.col("raw").cast("string"))),
            "raw": F.when(fits, F.col("raw")),
        }
    )


def prepare_files(inventory: DataFrame, max_size_mb: float | None = None, text_mode: str = "name") -> DataFrame:
    """Inventory to scan-ready files: ignore rules, flags, decoded content."""
    return with_content(with_flags(filter_ignored(inventory), text_mode), max_size_mb)


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"))
