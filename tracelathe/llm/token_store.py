"""Token ids in Simple-8b words, written and read back by Spark.

A segment is one row of the stored table: whole documents in order, their ids packed into 64-bit
words.  Every word starts with a 4-bit selector that tells how many ids share its other 60 bits.
Ids are packed in blocks of a fixed number; the word offset of every block is stored, so a reader
decodes blocks independently and all words of one selector at once.  An id of more than 60 bits
takes an escape selector, and its value follows after the words of its block.

Segments live in Parquet files, so that writing commits per task (a lost executor costs a re-run)
and any file system that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelathe.llm import token_units
from tracelathe.llm.byte_units import LOWER, words_alone
from tracelathe.llm.common import by_bytes, small_batches, texts_of

#: Fixed values of Simple-8b: how many integers a word holds, for selectors 0 to 13.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 4096

SEGMENT = ("shard int, segment int, shard_start long, n_ids long, doc_ids array<bigint>, lengths array<int>, "
           "block_words array<int>, block_escapes array<int>, words binary")


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[int], list[int]]:
    """All blocks of ``values`` after each other, and how many words and escapes each has."""
    n, gap = len(values), max(COUNTS)
    if not n:
        return b"", [], []
    values = values.astype(np.uint32 if int(values.max()) < 1 << 32 else np.uint64)
    blocks = -(-n // block)
    # Room after each block: what lies past its end fits any word.
    padded = np.zeros((blocks, block + gap), values.dtype)
    padded[:n // block, :block] = values[:n // block * block].reshape(-1, block)
    if n % block:
        padded[-1, :n % block] = values[n // block * block:]
    padded = padded.ravel()
    take, choice = np.ones(len(padded), np.uint8), np.full(len(padded), ESCAPE, np.uint8)
    # More ids to a word leave each fewer bits: where n ids don't fit, more won't.
    most, held, real = padded.copy(), 1, n - (blocks - 1) * block
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        for k in range(held, count):  # the greatest of ``count`` neighbours, for all places at once
            np.maximum(most[:-k], padded[k:], out=most[:-k])
        held, bits = count, 60 // count
        fits = most < padded.dtype.type(1 << bits) if bits < 8 * padded.itemsize else np.ones(len(most), bool)
        place = fits.reshape(blocks, -1)
        if not (place[:-1, :block].any() or place[-1, :real].any()):
            break
        np.putmask(take, fits, count)
        np.putmask(choice, fits, selector)
    steps, starts, words = take.tolist(), [], []
    add = starts.append
    for k in range(blocks):
        at, before = k * (block + gap), len(starts)
        end = at + min(block, n - k * block)
        while at < end:
            add(at)
            at += steps[at]
        words.append(len(starts) - before)
    starts = np.array(starts, np.int64)
    selectors = choice[starts]
    out = selectors.astype(np.uint64)
    for selector in np.unique(selectors).tolist():
        if selector != ESCAPE:
            count, mine = COUNTS[selector], np.flatnonzero(selectors == selector)
            first = starts[mine]
            packed = out[mine]
            for k in range(count):
                packed |= padded[first + k].astype(np.uint64) << np.uint64(4 + k * (60 // count))
            out[mine] = packed
    escaped = selectors == ESCAPE
    ends = np.cumsum(words)
    if not escaped.any():
        return out.astype("<u8").tobytes(), words, [0] * blocks
    many = np.diff(np.concatenate([[0], np.cumsum(escaped)[ends - 1]])).tolist()
    parts = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        parts += [out[a:b], padded[starts[a:b][escaped[a:b]]].astype(np.uint64)]
    return np.concatenate(parts).astype("<u8").tobytes(), words, many


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of one block."""
    selector = (words & np.uint64(15)).astype(np.int64)
    count = np.array([*COUNTS, 0, 1])[selector]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[start[mine]] = escapes
        else:
            bits = 60 // COUNTS[s]
            shift = np.uint64(4) + np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(bits)
            out[start[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out[:n]


def unpack_all(data: bytes, words: list[int], escapes: list[int], n: int, block: int = BLOCK) -> np.ndarray:
    raw, at, out = np.frombuffer(data, "<u8"), 0, []
    for k, (w, e) in enumerate(zip(words, escapes)):
        out.append(unpack(raw[at:at + w], raw[at + w:at + w + e], min(block, n - k * block)))
        at += w + e
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id",
                 text: str = "text", segment_ids: int = 1 << 18, slice_bytes: int = 1 << 21) -> None:
    """Encode all texts, append ``end_id`` to each document, write them in ascending order of ``doc_id``.

    Null texts are empty: the end id alone.  Rows of one id are ordered by text, null ids come
    first.  Documents stay whole: a segment ends with the slice that makes it full.
    An empty table makes an empty store.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_units.encoder(tokenizer_path, words_alone, LOWER)
        shard, number, shard_start = TaskContext.get().partitionId(), 0, 0
        ids, rows, lengths, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            data, words, escapes = pack(np.concatenate(rows))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()),
                "shard_start": pa.array([shard_start]), "n_ids": pa.array([held]),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "block_words": pa.array([words], pa.list_(pa.int32())),
                "block_escapes": pa.array([escapes], pa.list_(pa.int32())), "words": pa.array([data], pa.binary())})

        for batch in batches:
            seen = 0
            names = batch.column(0).to_pylist()
            for part in by_bytes(batch.column(1), slice_bytes):
                texts = texts_of(part)
                flat, borders = encoder.ids(texts)
                rows.append(np.insert(flat, borders[1:], end_id))
                sizes = np.diff(borders) + 1
                ids += names[seen:seen + len(texts)]
                lengths += sizes.tolist()
                seen, held = seen + len(texts), held + int(sizes.sum())
                if held >= segment_ids:
                    yield segment()
                    number, shard_start, ids, rows, lengths, held = number + 1, shard_start + held, [], [], [], 0
        if rows:
            yield segment()

    (small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
         .repartitionByRange(F.col("doc_id").asc_nulls_first())
         .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
         .mapInArrow(segments, SEGMENT).write.mode("overwrite").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit, BINARY)."""
    stored = spark.read.schema(SEGMENT).parquet(path)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("total"))  # one row per written partition
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_all(row["words"], row["block_words"], row["block_escapes"], row["n_ids"]).astype("<u4")
                ends = np.cumsum([0, *row["lengths"]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(ends[:-1] + row["shard_start"] + row["before"], pa.int64()),
                    "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    return (stored.join(before, "shard").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary"))
