"""Archives as tables of their members."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from palisade.schema import INVENTORY_MAX_BYTES
from palisade.sources.files import ARCHIVE_EXTS, IGNORED_DIRS, IGNORED_EXTS, declared_ext

# Limits against decompression bombs.
ARCHIVE_MAX_BYTES = 500 * 1024 * 1024
ARCHIVE_MAX_MEMBERS = 10_000
MAX_DEPTH = 3

MEMBERS = "repo_id string, archive string, ordinal int, depth int, path string, size long, raw binary"
_BATCH_BYTES = 4 * 1024 * 1024


def _suffix(name: str) -> str:
    return PurePosixPath(name).suffix.lower()


def _ignored(name: str) -> bool:
    return not IGNORED_DIRS_SET.isdisjoint(name.split("/")) or _suffix(name) in IGNORED_EXTS


IGNORED_DIRS_SET = frozenset(IGNORED_DIRS)


def _unsafe(name: str) -> bool:
    return ".." in PurePosixPath(name).parts or name.startswith("/") or ":" in name


def _zip_members(data: bytes) -> Iterator[tuple[str, int, object]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                yield info.filename, info.file_size, lambda i=info: archive.open(i)


def _tar_members(data: bytes, mode: str) -> Iterator[tuple[str, int, object]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as archive:
        for info in archive:
            if info.isfile():
                yield info.name, info.size, lambda i=info: archive.extractfile(i)


def _open(data: bytes, name: str, nested: bool) -> Iterator[tuple[str, int, object]]:
    """Members by file suffix at the top, by content below it (names of nested archives are not trusted)."""
    if nested:
        return _zip_members(data) if zipfile.is_zipfile(io.BytesIO(data)) else _tar_members(data, "r:*")
    suffix = _suffix(name)
    if suffix == ".zip":
        return _zip_members(data)
    if suffix in (".gz", ".tgz"):
        return _tar_members(data, "r:gz")
    return _tar_members(data, "r:") if suffix == ".tar" else iter(())


@dataclass(frozen=True)
class ArchiveLimits:
    """Limits of one archive, nested members included; None leaves a limit out. What a limit stops becomes an error row."""

    member_bytes: int | None = None
    total_bytes: int | None = None
    members: int | None = None
    depth: int = MAX_DEPTH


#: The fixed values above as a preset against decompression bombs.
BOMB_LIMITS = ArchiveLimits(INVENTORY_MAX_BYTES, ARCHIVE_MAX_BYTES, ARCHIVE_MAX_MEMBERS)

# What a damaged archive may raise while it is listed or read; what came before the damage is kept.
_DAMAGE = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError)


class _Stop(Exception):
    """The budget of an archive is used up."""


class _Budget:
    def __init__(self, limits: ArchiveLimits):
        self.limits, self.bytes, self.count = limits, 0, 0

    def read(self, opener) -> bytes | None:
        """A member's bytes as they really are; None if it holds more than a member may."""
        limits = self.limits
        most = min((x for x in (limits.member_bytes, None if limits.total_bytes is None else limits.total_bytes - self.bytes) if x is not None), default=None)
        with opener() as stream:
            data = stream.read() if most is None else stream.read(most + 1)
        if most is not None and len(data) > most:
            if limits.member_bytes is not None and len(data) > limits.member_bytes:
                return None
            raise _Stop(f"more than {limits.total_bytes} bytes")
        self.bytes += len(data)
        return data

    def accept(self) -> None:
        if self.limits.members is not None and self.count >= self.limits.members:
            raise _Stop(f"more than {self.limits.members} members")
        self.count += 1


def _walk(data: bytes, name: str, budget: _Budget, depth: int) -> Iterator[tuple[int, str, int | None, bytes | None, str | None]]:
    """(depth, path, size, bytes, reason) of members as they come; reason says why one is missing or where reading ended."""
    prefix = "" if depth == 0 else f"{PurePosixPath(name).stem}/"
    try:
        for member, size, opener in _open(data, name, nested=depth > 0):
            path = prefix + member
            if _unsafe(member) or _ignored(path):
                continue
            if budget.limits.member_bytes is not None and size > budget.limits.member_bytes:
                yield depth, path, size, None, f"more than {budget.limits.member_bytes} bytes"
                continue
            nested = _suffix(member) in ARCHIVE_EXTS
            if nested and depth > 0:
                yield depth, path, size, None, "an archive inside a nested one"
                continue
            body = budget.read(opener)
            if body is None:
                yield depth, path, size, None, "it holds more than it declares"
            elif nested and budget.limits.depth > 0:
                yield from _walk(body, member, budget, depth + 1)
            else:
                budget.accept()
                yield depth, path, size, body, None
    except _DAMAGE as error:
        yield depth, name, None, None, f"damaged: {type(error).__name__}"


def _expand(data: bytes | None, name: str, limits: ArchiveLimits) -> Iterator[tuple[int, str, int | None, bytes | None, str | None]]:
    if data is None:
        yield 0, name, None, None, "the bytes are missing"
        return
    try:
        yield from _walk(data, name, _Budget(limits), 0)
    except _Stop as stop:
        yield 0, name, None, None, str(stop)


def read_archives(archives: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    """Members and errors of archives (repo_id, path, raw): one task reads an archive, archives spread over the cluster.

    Members leave as they are read, nested ones too, so a worker holds one member and one batch at a time. Rows with a reason
    stand for what is missing: null bytes, damage, and what a limit stopped.
    """
    limits = limits or ArchiveLimits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            # One archive at a time leaves the batch; the others stay in its buffers, uncopied.
            for repo_id, path, raw in zip(batch["repo_id"], batch["path"], batch["raw"]):
                repo_id, path, ordinal = repo_id.as_py(), path.as_py(), 0
                for depth, member, size, body, reason in _expand(raw.as_py(), path, limits):
                    rows.append((repo_id, path, ordinal, depth, member, size, body, reason))
                    ordinal += reason is None
                    held += len(body or b"") + 200
                    if held >= _BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    wanted = archives.where(declared_ext(F.col("path")).isin(*ARCHIVE_EXTS)).select("repo_id", "path", "raw")
    return wanted.mapInArrow(run, MEMBERS + ", reason string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in (MEMBERS + ", reason string").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])


def expand_archives(archives: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    """Members of archives; without limits all of them. ``archive_errors`` says what is missing."""
    return read_archives(archives, limits).where("reason is null").drop("reason")


def archive_errors(archives: DataFrame, limits: ArchiveLimits | None = None) -> DataFrame:
    rows = read_archives(archives, limits).where("reason is not null")
    return rows.select("repo_id", F.col("archive").alias("path"), F.lit("archive").alias("stage"), F.concat("path", F.lit(": "), "reason").alias("reason"))


def archive_budget(members: DataFrame, max_bytes: int = ARCHIVE_MAX_BYTES, max_members: int = ARCHIVE_MAX_MEMBERS) -> DataFrame:
    """Cut member listings (archive, ordinal, size) where the budget ends.

    ``ordinal`` counts accepted members from 0, so the member limit is a filter and no window sees more rows than it.
    """
    so_far = Window.partitionBy("repo_id", "archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return (
        members.where(F.col("ordinal") < max_members)
        .withColumn("running_size", F.sum("size").over(so_far))
        .where(F.col("running_size") <= max_bytes)
    )


def members_as_files(members: DataFrame) -> DataFrame:
    """Members as an inventory, their repository named after the archive."""
    return members.select(
        F.concat_ws("!", "repo_id", "archive").alias("repo_id"), "path", "size", "raw"
    )
