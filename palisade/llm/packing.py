"""Best-fit packing of token sequences with matched large items.

The plan is made on counts of lengths, of which there are at most as many as the capacity, so it never grows with the data:

* Pieces above a third of the capacity fit at most twice into a bin. From the longest down, each is matched with the longest
  other one that still fits; one without a partner opens a bin alone.
* Pieces of a third or less go, from the longest down, to the bin with the smallest gap that takes them; a bin is filled with
  as many of one length as fit. A new bin opens when no gap is left.

Bins with equal content form one group, so the plan is a short list of (length, ranks, first bin, offset, items a bin). Each
piece finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import free_names, release_memory, shard_count, small_arrow_batches, stored, text_key
from palisade.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0
ROWS_PER_BUCKET = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens of every row of (doc_id, text): its ids and then end_id; only longer ones are cut.

    Null texts count as empty and yield the end id alone. A null doc_id stays null. Repeated rows yield repeated pieces.
    row_key is a hash of id and text. The tokenizer must drop white space (see tokens.py).
    """
    small_arrow_batches(documents.sparkSession)
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        coder = encoder(tokenizer)
        for batch in batches:
            doc, piece, start, length, crc, key = [], [], [], [], [], []
            for doc_id, text, row_key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = coder.id_bytes(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    doc.append(doc_id), piece.append(n), start.append(at // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part)), key.append(row_key)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_key"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc, piece, start, length, crc, key), kinds)], names)
        coder.clear()

    key = text_key("text")["a"].bitwiseXOR(F.xxhash64("doc_id"))
    return documents.select(F.col("doc_id").cast("long"), "text", key.alias("row_key")).mapInArrow(cut, PIECES)


class _Bins:
    """Groups of bins by gap: smallest gap that takes a length, in logarithmic time."""

    def __init__(self) -> None:
        self.by_gap: dict[int, list[tuple[int, int, int]]] = {}
        self.gaps: list[int] = []
        self.next = 0

    def add(self, gap: int, first: int, n: int, filled: int) -> None:
        if n and gap:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((first, n, filled))

    def take(self, length: int) -> tuple[int, int, int, int] | None:
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, n, filled = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[at]
        return gap, first, n, filled

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, end rank, first bin, offset, items a bin) and the number of bins.

    Pieces of `length` with rank r in [first rank, end rank) go to bin first + (r - rank) // items, at
    offset + (r - rank) % items * length.
    """
    if any(length < 1 or length > capacity for length in counts):
        raise ValueError("lengths lie between 1 and the capacity")
    left = {length: n for length, n in counts.items() if n > 0}
    ranks = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    bins = _Bins()

    def place(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        segments.append((length, ranks[length], ranks[length] + n, first, offset, each))
        ranks[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            n = left[a]
            place(a, n, first := bins.open(n), 0)
            bins.add(capacity - a, first, n, a)
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # a single one of this length is left: its partner is the next shorter
                if at == 0:
                    place(a, 1, first := bins.open(1), 0)
                    bins.add(capacity - a, first, 1, a)
                    large.remove(a)
                    continue
                b, n = large[at - 1], 1
            first = bins.open(n)
            place(a, n, first, 0)
            place(b, n, first, a)
            bins.add(capacity - a - b, first, n, a + b)
        large = [x for x in large if left[x]]

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            found = bins.take(length)
            if found is None:
                n = -(-left[length] // (capacity // length))
                bins.add(capacity, bins.open(n), n, 0)
                continue
            gap, first, n, filled = found
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                place(length, full * each, first, filled, each)
                bins.add(gap - each * length, first, full, filled + each * length)
            first, n = first + full, n - full
            if n and left[length]:
                rest = left[length]
                place(length, rest, first, filled, rest)
                bins.add(gap - rest * length, first, 1, filled + rest * length)
                first, n = first + 1, n - 1
            bins.add(gap, first, n, filled)
    return segments, bins.next


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """pieces with sequence_id long and offset long.

    pieces needs length (1 to capacity; others raise) and row_key, piece for a stable order; it is stored first. Pieces of one
    length are ranked in buckets of bounded size, so a length that holds most rows is no hot key. Equal lengths are ties that
    any order settles. An empty table stays empty.
    """
    n = pieces.count()
    buckets = shard_count(n, rows_per_bucket, 8)
    bucket, row, place_in, of_length, of_bucket, first = free_names(pieces.columns, "_bucket", "_row", "_rank", "_l", "_b", "_first")
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64("row_key", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias(of_length), F.col(bucket).alias(of_bucket), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    counts = {row["length"]: row["n"] for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    segments, _ = plan(counts, capacity)

    grouped: dict[int, list] = {}
    for segment in segments:
        grouped.setdefault(segment[0], []).append(segment[1:])
    by_length = {length: tuple(np.array(c, np.int64) for c in zip(*sorted(own))) for length, own in grouped.items()}

    inside = Window.partitionBy("length", bucket).orderBy("row_key", "piece", "start")
    ranked = dealt.withColumn(row, F.row_number().over(inside) - 1).join(starts, (F.col("length") == F.col(of_length)) & (F.col(bucket) == F.col(of_bucket)))
    ranked = ranked.withColumn(place_in, F.col(first) + F.col(row)).drop(of_length, of_bucket, bucket, first, row)
    kept = [c for c in ranked.columns if c != place_in]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column(place_in).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, at = np.unique(length[order], return_index=True)
            for value, rows in zip(values, np.split(order, at[1:])):
                first_rank, _, first_bin, filled, each = by_length[int(value)]
                s = np.searchsorted(first_rank, rank[rows], "right") - 1
                inner = rank[rows] - first_rank[s]
                sequence[rows] = first_bin[s] + inner // each[s]
                offset[rows] = filled[s] + inner % each[s] * value
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ranked.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """token_pieces and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    return pack(stored(token_pieces(documents, tokenizer, capacity, end_id), "pieces"), capacity).drop("row_key")
