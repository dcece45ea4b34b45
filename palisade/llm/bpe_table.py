"""BPE encoding and decoding through distinct words.

1. Tasks cut whole texts into words, block by block of texts. A block numbers its words; its texts become lists of these numbers.
2. The words of all blocks meet in a shuffle on the word. Each distinct word is encoded once and answers to all its blocks.
3. The answers return to their block, where the positions are filled in: ids, and pieces by a join with the id-to-piece table,
   which is bounded by the vocabulary and therefore sent to every task.

The texts themselves never travel, and a word at most once a block. A block's number is a hash of its partition, its place there,
its doc_ids and its words in their order, so it is the same whenever the block is worked out again, as after the loss of an
executor, and blocks of copies stay apart; nothing has to be written in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import small_arrow_batches
from palisade.llm.tokens import encoder

WORDS_PER_BLOCK = 5_000_000
WORDS_PER_ROW = 10_000
VOCABULARY_BOUND = 2_000_000


def _squeeze(codes: list[int]) -> bytes:
    """Numbers as byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(np.array(codes, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[int, list[str], list[tuple[list, list, bytes]]]]:
    """(block number, words, [(ids of texts, word counts, word numbers)]) of the texts of a partition."""
    import xxhash
    from pyspark import TaskContext

    task = TaskContext.get()
    partition, place = task.partitionId() if task else 0, 0
    words_of = encoder(tokenizer).words
    numbers: dict[str, int] = {}
    rows: list[tuple[list, list, bytes]] = []
    total = 0

    def block() -> tuple[int, list[str], list[tuple[list, list, bytes]]]:
        words = list(numbers)
        own = xxhash.xxh64(f"{partition} {place} ")
        for ids, _, _ in rows:
            own.update(f"{ids}")
        own.update("\x00".join(words))
        return own.intdigest() - 2**63, words, rows

    for batch in batches:
        codes: list[int] = []
        lengths = []
        for text in batch.column(1):
            words = words_of(text.as_py() or "")
            for w in words:
                if w not in numbers:
                    numbers[w] = len(numbers)
            codes += [numbers[w] for w in words]
            lengths.append(len(words))
        rows.append((batch.column(0).to_pylist(), lengths, _squeeze(codes)))
        total += len(codes)
        if total >= WORDS_PER_BLOCK:
            yield block()
            numbers, rows, total, place = {}, [], 0, place + 1
    if rows:
        yield block()


def encode_and_decode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of (doc_id, text), as the tokenizers library gives them.

    documents must read alike when read twice, as stored tables do; a difference raises. Valid for tokenizer files without a
    post-processor and decoder that drop white space. Null and empty texts have no ids and an empty text; a null doc_id stays null;
    repeated rows come back as often; an empty table stays empty. Other columns are not read. A single very long text is a block
    of its own.
    """
    small_arrow_batches(documents.sparkSession, "2m")
    pieces = {i: p for p, i in encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).items()}
    if len(pieces) > VOCABULARY_BOUND:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is too large to send")
    narrow = np.dtype("<u2" if max(pieces, default=0) < 2**16 else "<u4")
    texts = documents.select(F.col("doc_id").cast("long"), "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own, _ in _blocks(batches, tokenizer):
            for at in range(0, len(own), WORDS_PER_ROW):
                part = own[at : at + WORDS_PER_ROW]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32))], ["word", "block", "number"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own, rows in _blocks(batches, tokenizer):
            for ids, lengths, codes in rows:
                columns = [pa.array([block]), pa.array([len(own)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([codes])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "words", "doc_ids", "lengths", "codes"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words follow each other, so each is encoded once."""
        for batch in batches:
            word = batch.column(0).dictionary_encode()
            ids = pa.array([np.array(x, narrow).tobytes() for x in encoder(tokenizer).encode_words(word.dictionary.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), ids.take(word.indices)], ["of", "number", "ids"])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = right["number"].to_numpy()
        if not left.num_rows:
            raise RuntimeError("the texts changed between two readings")
        _, first = np.unique(numbers, return_index=True)
        if len(first) != left["words"][0].as_py():
            raise RuntimeError("the texts changed between two readings")
        column = right["ids"].combine_chunks().take(pa.array(first))
        counts = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // narrow.itemsize
        flat = np.frombuffer(b"".join(column.to_pylist()), narrow).astype(np.int32)
        starts = np.cumsum(counts) - counts
        flat_pieces = list(map(pieces.__getitem__, flat.tolist()))
        decoded = [flat_pieces[s] if n == 1 else " ".join(flat_pieces[s : s + n]) for s, n in zip(starts.tolist(), counts.tolist())]
        some_empty = bool((counts == 0).any())
        del flat_pieces, first, numbers
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        out = []
        for row in range(left.num_rows):
            codes = _unsqueeze(left["codes"][row].as_py())
            lengths = np.array(left["lengths"][row].as_py(), np.int64)
            n = counts[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
            stops = np.cumsum(lengths)
            offsets = pa.array(ends[np.concatenate([[0], stops])], pa.int32())
            numbered, texts = codes.tolist(), []
            for stop, length in zip(stops.tolist(), lengths.tolist()):
                own = numbered[stop - length : stop]
                texts.append(" ".join([p for w in own if (p := decoded[w])] if some_empty else [decoded[w] for w in own]))
            columns = [left["doc_ids"][row].values, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(texts, pa.string())]
            out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        return pa.Table.from_batches(out, schema)

    asked = texts.mapInArrow(words, "word string, block long, number int").repartition("word").sortWithinPartitions("word")
    answered = asked.mapInArrow(encode, "of long, number int, ids binary")
    coded = texts.mapInArrow(positions, "block long, words int, doc_ids array<long>, lengths array<int>, codes binary")
    return coded.groupBy("block").cogroup(answered.groupBy("of")).applyInArrow(fill, "doc_id long, ids array<int>, decoded string")
