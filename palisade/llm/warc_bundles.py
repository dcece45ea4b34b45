"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records, closed by a seek table in a skippable frame
(the public seekable format: per frame its compressed and its plain size, then the number of frames, a descriptor byte and a
magic number). Any Zstandard reader decodes a bundle front to back; a reader of the table decodes one frame alone. The index maps
each record to its bundle, frame, and offset inside the plain frame.

Tasks write their bundles straight to the shared folder under names of their own, so a repeated attempt never touches a file that
an index row already names; the index is stored once, by the attempt that counts. Payloads travel once, grouped by nothing but a
hash of page and digest; which record of equal payloads is the response is settled on 36 bytes a page.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm.common import new_folder, small_arrow_batches, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
LEVEL = 3
#: Fixed values of the seekable format and of WARC.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def _file_system(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without its payload; both keep the payload's length in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; malformed records raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Writes one bundle; add() returns (frame, offset inside it)."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):  # noqa: ANN001
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame, self.size, self.table, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.table), self.size
        self.frame.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        if self.size:
            data = self.compressor.compress(b"".join(self.frame))
            self.stream.write(data)
            self.table.append((len(data), self.size))
            self.written += len(data)
            self.frame, self.size = [], 0

    def close(self) -> None:
        self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, file):  # noqa: ANN001
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        file.seek(size - 9 - 8 * n)
        self.table, at = [], 0
        for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
            self.table.append((at, packed, plain))
            at += packed
        self.open: tuple[int, bytes] | None = None

    def frame(self, number: int) -> bytes:
        import zstandard

        if self.open is None or self.open[0] != number:
            at, packed, plain = self.table[number]
            self.file.seek(at)
            data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)
            self.open = number, data
        return self.open[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def write_bundles(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for every row of (page_id, url, html) and return the stored index.

    Of records with equal payloads of at least `least_bytes` bytes, that with the largest page_id is the response, the others
    revisit it; smaller payloads are responses. A null html is an empty payload. A null page_id sorts below all others and its
    record has an empty id; rows that repeat both page_id and payload of a response are responses too. A record longer than
    a frame has a frame of its own. An empty table writes no bundle.
    """
    spark = pages.sparkSession
    small_arrow_batches(spark, "8m")
    folder = folder or new_folder(spark, "warc")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    payload = F.encode("html", "utf-8")
    keyed = rows.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length("html").cast("long").alias("n"))
    ids = keyed.where(F.col("n") >= least_bytes).select("page_id", "sha", "n")
    latest = ids.groupBy("sha", "n").agg(F.max("page_id").alias("latest"), F.count("*").alias("k")).where("k > 1 and latest is not null")
    revisits = ids.join(latest, ["sha", "n"]).where(~F.col("page_id").eqNullSafe(F.col("latest"))).groupBy("page_id", "sha", "n").agg(F.max("latest").alias("refers_to"))
    other = revisits.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("n").alias("m"), "refers_to")
    decided = keyed.join(other, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("n") == F.col("m")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        name = stream = writer = None
        out: list[tuple] = []
        names = ["page_id", "record_id", "bundle", "frame", "offset", "length"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(stream, frame_bytes)
                record = make_record(page_id, url.as_py(), html.as_py().encode(), refers_to)
                out.append((page_id, record_id(page_id), f"{folder}/{name}", *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return stored(decided.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame) -> DataFrame:
    """Read the records of index rows back: page_id, record_id, record_type, payload_digest, payload_bytes, refers_to, payload binary.

    Rows are grouped by frame, so each frame is decoded once; a payload that does not match its digest raises. A revisit has no
    payload of its own (null). Any part of an index may be read.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, BundleReader] | None = None
        names = ["page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())

        def number(urn: str) -> int | None:
            return int(urn) if (urn := urn.removeprefix("<urn:page:").removesuffix(">")) else None

        for batch in batches:
            out, size = [], 0
            for wanted, uri, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("record_id", "bundle", "frame", "offset", "length"))):
                if open_ is None or open_[0] != uri:
                    fs, path = _file_system(uri)
                    open_ = uri, BundleReader(fs.open_input_file(path))
                headers, http, payload = parse_record(open_[1].record(frame, offset, length))
                sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if headers["WARC-Record-ID"] != wanted or kind == "response" and (digest(payload) != sha or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"record {wanted} is damaged")
                target = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((number(wanted), wanted, kind, sha, int(http["Content-Length"]), target, payload if kind == "response" else None))
                size += len(payload)
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    dealt = index.repartition("bundle", (F.col("frame") / 16).cast("int")).sortWithinPartitions("bundle", "frame", "offset")
    schema = "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    return dealt.mapInArrow(read, schema)


def find_records(spark: SparkSession, index: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of some pages, by seeking."""
    return read_bundles(index.where(F.col("page_id").isin(page_ids)))
