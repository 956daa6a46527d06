"""Substring dedup: every window of a fixed number of words is hashed, counted, and merged into intervals.

A window's Rabin-Karp hash is a polynomial in its words' 64-bit hashes, rolled over a text by running sums.
All windows of all texts are counted in three steps, none of which holds a row per window.

1. A task packs the windows of many texts into a block and sorts them by hash.  Of equal windows of a block only the
   one of the least id is sent on; those of larger ids are repeated for certain, and those of the same id
   share its fate (aliases).  So a window that a third of all texts hold is one entry per block.
2. Entries travel in packed rows to the bucket of their hash (its leading bits; as many buckets as the bytes ask
   for).  A bucket holds every occurrence of its hashes, finds the least id of each, and answers the block of every entry
   of a larger id with the entry's offset.
3. A block's answers meet; its windows become runs, and a run of windows a maximal interval of words of one text.

The intervals are joined to the texts by id and digest.  Hashes are 64-bit mixes of whole words: the chance that any two of
n different windows meet is about n^2 / 2^65 (one in 2,000 for 10^8 windows); ``seed`` gives other hashes to compare with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import plain, small_batches, texts_of

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LARGEST = np.iinfo(np.int64).max
_ROW = ("bucket int, block long, hashes binary, offsets binary, owners binary, ids binary, firsts binary, "
        "digests binary, known binary, aliases binary")
_ANSWER = "block long, offsets binary, ids binary, firsts binary, digests binary, bases binary, aliases binary"


def words_of(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (null: none), and where each text's begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at either end leaves an empty word
    borders = np.asarray(lists.offsets, dtype=np.int64)
    borders = np.concatenate([[0], np.cumsum(real)])[borders - borders[0]]
    coded = pc.dictionary_encode(flat.filter(pa.array(real)))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    hashes = np.array([xxhash.xxh3_64_intdigest(w.as_buffer(), seed) for w in coded.dictionary], np.uint64)
    return (hashes[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)), borders


class Roller:
    """Rabin-Karp hashes of all windows of ``length`` words, powers of the base kept from call to call."""

    def __init__(self, length: int):
        self.length, self.up, self.down = length, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n < self.length:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
                                  for b in (_BASE, _INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)])
        out = (sums[self.length:] - sums[:-self.length]) * self.down[:n - self.length + 1]
        out ^= out >> np.uint64(32)  # one to one, so that the leading bits depend on all others
        out *= np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(29))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their bytes of one rank after each other: small ones compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _sums(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_numbers(raw, kind), dtype=kind)


class Block:
    """Windows of many texts on their way to their buckets.  ``ids``, ``digests`` and ``bases`` (number of the first window held
    here within its text) have one entry per text, or part of a text."""

    def __init__(self, number: int):
        self.number, self.n, self.hashes, self.sizes, self.ids, self.digests, self.bases = number, 0, [], [], [], [], []

    def add(self, hashes: np.ndarray, doc_id: int, digest: bytes, base: int) -> None:
        self.n += len(hashes)
        for held, x in ((self.hashes, hashes), (self.sizes, len(hashes)), (self.ids, doc_id), (self.digests, digest), (self.bases, base)):
            held.append(x)

    def rows(self, bits: int) -> Iterator[dict]:
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes)
        firsts = (np.cumsum(sizes) - sizes).astype(np.uint32)
        hashes, owner = np.concatenate(self.hashes), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        group = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        many = np.diff(np.append(group, len(hashes)))
        doc = ids[owner[order]]
        least = np.minimum.reduceat(doc, group)
        later = doc > np.repeat(least, many)
        known = np.sort(order[later]).astype(np.uint32)
        stays = np.flatnonzero(~later)
        new = np.concatenate([[True], hashes[stays][1:] != hashes[stays][:-1]])
        sent = stays[new]
        # The other entries of a hash's least id follow the one that is sent.
        same = stays[~new]
        aliases = np.stack([order[sent[np.cumsum(new)[~new] - 1]], order[same]]).astype(np.uint32)
        yield {"bucket": self.number % (1 << bits), "block": self.number, "ids": ids.tobytes(), "firsts": firsts.tobytes(),
               "digests": b"".join(self.digests), "known": _steps(known), "aliases": aliases.tobytes(), "owners": np.array(self.bases, np.int64).tobytes()}
        hashes, offsets, owner = hashes[sent], order[sent].astype(np.uint32), owner[order[sent]]
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(hashes))):
            mine = np.unique(owner[a:b])
            yield {"bucket": int(bucket[a]), "block": self.number, "hashes": _steps(hashes[a:b]), "offsets": _planes(offsets[a:b]),
                   "ids": _steps(ids[mine]), "firsts": _steps(firsts[mine])}


def postings(docs: DataFrame, length: int, bits: int, seed: int, block_windows: int) -> DataFrame:
    """The packed windows of ``docs`` (id, text), and one row per block that describes its texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, schema = Roller(length), pa.schema([(c, t) for c, t in zip((x.split()[0] for x in _ROW.split(", ")),
                                                                          [pa.int32(), pa.int64(), *[pa.binary()] * 8])])
        number = TaskContext.get().partitionId() << 32
        block = Block(number)

        def packed() -> Iterator[pa.RecordBatch]:
            for row in block.rows(bits):
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            words, borders = words_of(texts, seed)
            for k, (a, b) in enumerate(zip(borders.tolist(), borders[1:].tolist())):
                if b - a < length:
                    continue
                hashes, digest = roll(words[a:b]), xxhash.xxh3_128_digest(texts[k].as_buffer())
                for base in range(0, len(hashes), block_windows):
                    part = hashes[base:base + block_windows]
                    if block.n and block.n + len(part) > block_windows:
                        yield from packed()
                        number += 1
                        block = Block(number)
                    block.add(part, ids[k], digest, base)
        if block.n:
            yield from packed()

    return docs.mapInArrow(rows, _ROW)


def answers(posted: DataFrame) -> DataFrame:
    """Per block: its description, and from every bucket the offsets of windows that a smaller id holds, too."""
    schema = pa.schema([("block", pa.int64()), *((c.split()[0], pa.binary()) for c in _ANSWER.split(", ")[1:])])

    def solve(rows: list[dict]) -> Iterator[dict]:
        hashes = [_sums(r["hashes"], np.uint64) for r in rows]
        offsets = [_numbers(r["offsets"], np.uint32) for r in rows]
        ids = [_sums(r["ids"], np.int64)[np.searchsorted(_sums(r["firsts"], np.uint32), o, "right") - 1] for r, o in zip(rows, offsets)]
        ends = np.cumsum([0, *map(len, hashes)])
        hashes, ids = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(hashes)
        hashes = hashes[order]
        group = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids[order], group), np.diff(np.append(group, len(hashes))))
        later = np.zeros(len(ids), bool)
        later[order] = ids[order] > least
        for r, o, a, b in zip(rows, offsets, ends, ends[1:]):
            if later[a:b].any():
                yield {"block": r["block"], "offsets": _steps(np.sort(o[later[a:b]]))}

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["hashes"] is None:
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "offsets": row["known"], "ids": row["ids"], "firsts": row["firsts"],
                                                       "digests": row["digests"], "bases": row["owners"], "aliases": row["aliases"]}], schema)
                    continue
                if held and row["bucket"] != bucket:
                    yield pa.RecordBatch.from_pylist(list(solve(held)), schema)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(solve(held)), schema)

    return small_batches(posted.repartition("bucket").sortWithinPartitions("bucket")).mapInArrow(batches_of, _ANSWER)


def runs(answered: DataFrame, length: int) -> DataFrame:
    """id, digest, start, end: maximal intervals of words covered by the windows answered (parts of a long text apart)."""
    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        about = next(r for r in rows if r["ids"] is not None)
        ids, firsts, bases = (np.frombuffer(about[c], t) for c, t in (("ids", np.int64), ("firsts", np.uint32), ("bases", np.int64)))
        flagged = np.unique(np.concatenate([_sums(r["offsets"], np.uint32) for r in rows]))
        heads, others = np.frombuffer(about["aliases"], np.uint32).reshape(2, -1)
        at = np.searchsorted(flagged, heads)
        found = (at < len(flagged)) & (flagged[np.minimum(at, max(0, len(flagged) - 1))] == heads) if len(flagged) else np.zeros(len(heads), bool)
        flagged = np.unique(np.concatenate([flagged, others[found]])).astype(np.int64)
        owner = np.searchsorted(firsts, flagged, "right") - 1
        place = flagged - firsts[owner] + bases[owner]
        # A gap of up to ``length`` words between starts leaves no word free.
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + length)])) if len(place) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(place)) - 1 if len(place) else new
        return pa.table({"id": pa.array(ids[owner[new]], pa.int64()), "digest": pa.array([about["digests"][16 * k:16 * k + 16] for k in owner[new].tolist()], pa.binary()),
                         "start": pa.array(place[new], pa.int64()), "end": pa.array(place[last] + length, pa.int64())})

    return answered.groupBy("block").applyInArrow(merge, "id long, digest binary, start long, end long")


def repeated_intervals(df: DataFrame, length: int = 13, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 12 << 20,
                       least_bits: int = 6, block_windows: int = 1 << 21, seed: int = 0) -> DataFrame:
    """id, digest (xxh3, 128 bits), intervals (array of start, end in words): per text of an id, what ``without_repeated_windows`` removes."""
    total = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    bits = max(least_bits, (int(total) // bucket_bytes).bit_length())
    docs = small_batches(df).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LARGEST)).alias("id"), F.col(text).alias("text"))
    found = runs(answers(postings(docs, length, bits, seed, block_windows)), length)
    return found.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("intervals"))  # at most one per window


def without_repeated_windows(df: DataFrame, length: int = 13, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows of ``df`` with n_words (LONG), removed (ARRAY of start and end, in words, maximal, sorted), kept (STRING: the words left, joined by a blank).

    Words are runs of anything but white space (0x20, 0x09-0x0D), taken unchanged.  A word goes if a window of ``length`` words that
    covers it also starts in a row of a smaller ``doc_id``; windows are judged on the input.  Rows of one id are no earlier than
    each other, so nothing goes for repeats within a row, or among rows of one id.  Null ids count as the largest.
    Null texts have no words; rows with fewer words than ``length`` stay whole.  An empty table gives an empty table; input columns
    named as the new ones give way.  A text is held whole in one task (some four times its bytes).  If ``df``
    comes from a shuffle, write it first: a task that is run again must find its rows in the same order."""
    df = plain(df, "n_words", "removed", "kept")
    found = repeated_intervals(df, length, doc_id, text, **options).withColumnsRenamed({"id": "__of", "digest": "__name"})

    @F.arrow_udf("binary")
    def named(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())

    @F.arrow_udf("struct<n_words: bigint, removed: array<struct<start: bigint, end: bigint>>, kept: string>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        counts, gone, left = [], [], []
        for t, list_ in zip(texts_of(texts), lists.to_pylist()):
            words, merged = t.encode("utf-8", "surrogatepass").split(), []  # bytes part at these six signs
            for a, b in sorted((s["start"], s["end"]) for s in list_ or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            counts.append(len(words))
            gone.append([{"start": a, "end": b} for a, b in merged])
            for a, b in reversed(merged):
                del words[a:b]
            left.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone, spans), pa.array(left, pa.string())], ["n_words", "removed", "kept"])

    rows = small_batches(df).withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LARGEST))).withColumn("__digest", named(F.col(text)))
    rows = rows.join(found.hint("merge"), (F.col("__id") == F.col("__of")) & (F.col("__digest") == F.col("__name")), "left")
    return rows.withColumn("__cut", cut(F.col(text), F.col("intervals"))).select(*[df[c] for c in df.columns], "__cut.n_words", "__cut.removed", "__cut.kept")
