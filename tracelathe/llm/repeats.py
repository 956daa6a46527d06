"""Repeated passages: bytes covered by a string of a given length that starts elsewhere, too.

Bucket-pointer refinement over sampled suffixes.  The bucket of a position for strings of length
2k is made of the bucket of its first k bytes and the bucket k bytes on; one array of bucket
identifiers per document is reused from level to level up to q = half the wanted length, and once
more for the full length.  Identifiers are 64-bit mixes of the two, so they need no global ranks.

Positions are sampled, so that far fewer than all suffixes are shuffled: an anchor is a position
whose q-bucket is the least of some window of the wanted length.  Equal windows hold equal anchors
at equal offsets, so every repeated string has an anchor that it shares with its twin.

1. Initial buckets: anchors by their q-bucket, and by the bucket of their surroundings (all windows
   around the anchor).  Counting them needs one row per anchor, combined before the shuffle.
2. Buckets of one anchor are done.  Surroundings that occur twice are repeated throughout.
3. What is left (an anchor that recurs in other surroundings) is refined: the distinct
   surroundings of a bucket meet, the identifiers of their windows at later offsets are
   made and sorted, and windows that occur twice come out.  Buckets with more than ``hot`` distinct
   surroundings are not put into one task; their windows are counted as rows.
4. The covered bytes are cut out of each document.

Texts are named by a 128-bit digest, so repeated ids, nulls and copies need no special care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import delete, materialize, plain, small_batches, texts_of

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of a string from the buckets of two parts."""
    x = a * _A + b
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


_BYTES = _join(np.arange(256, dtype=np.uint64) + np.uint64(1), np.full(256, 77, np.uint64))


def buckets(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of all strings of ``length`` bytes, by refinement at later offsets."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    if length == 1:
        return _BYTES[data]
    half = (length + 1) // 2  # for an odd length the parts overlap by one byte
    part = buckets(data, half)
    return _join(part[:len(part) - (length - half)], part[length - half:])


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` consecutive values."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return op(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(q_buckets: np.ndarray, width: int) -> np.ndarray:
    """Positions whose bucket is the least of some ``width`` consecutive ones."""
    if len(q_buckets) < width:
        return np.zeros(0, np.int64)
    least = _slide(q_buckets, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == q_buckets)


def _digest(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """One row per anchor: digest of the text, position, q-bucket, bucket of its surroundings."""
    q = length // 2
    width = length - q + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, places, keys, outers = [], [], [], []
            for text in texts_of(batch.column(0)):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                data = np.frombuffer(raw, np.uint8)
                small = buckets(data, q)
                at = anchors(small, width)
                full = _join(small[:len(small) - (length - q)], small[length - q:]) if length == 2 * q else buckets(data, length)
                a, b = np.maximum(at - (length - q), 0), np.minimum(at + length, len(data))
                outer = _join(_join(full[a], full[b - length]), ((b - a) * 65536 + (at - a)).astype(np.uint64))
                names += [_digest(raw)] * len(at)
                places.append(at)
                keys.append(small[at])
                outers.append(outer)
            yield _arrow(digest=pa.array(names, pa.binary()),
                         pos=pa.array(np.concatenate(places) if places else np.zeros(0, np.int64), pa.int64()),
                         bucket=pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)),
                         outer=pa.array(np.concatenate(outers).view(np.int64) if outers else np.zeros(0, np.int64)))

    return texts.mapInArrow(rows, "digest binary, pos long, bucket long, outer long")


def _runs(pos: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return pos + edge[::2], pos + edge[1::2]


def _windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the windows of each part, one after the other, and how many each has."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    count = sizes - length + 1
    start = np.repeat(np.cumsum(sizes) - sizes, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return buckets(data, length)[start + inner], count


def refine(contexts: DataFrame, length: int, slice_rows: int = 2048) -> DataFrame:
    """From distinct surroundings (bucket, digest, start, bytes) to repeated spans (digest, start, end).
    Rows of a bucket meet in one task; slices end between buckets."""
    rows = contexts.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "digest", "start", "bytes")

    def solve(digests, starts, parts) -> pa.RecordBatch:
        ids, count = _windows(parts, length)
        # Anchors near each other see the same window: it recurs only where its places differ.
        text = np.unique(np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64), return_inverse=True)[1]
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat((text << 40) + np.array(starts), count) + inner
        order = np.lexsort((place, ids))
        sorted_ids, sorted_place = ids[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        last = np.concatenate([first[1:], [len(ids)]]) - 1
        twice = np.zeros(len(ids), bool)
        twice[order] = np.repeat(sorted_place[first] != sorted_place[last], last - first + 1)
        names, begin, end, at = [], [], [], 0
        for k, n in enumerate(count.tolist()):
            a, b = _runs(starts[k], twice[at:at + n])
            names += [digests[k]] * len(a)
            begin += a.tolist()
            end += (b + (length - 1)).tolist()
            at += n
        return _arrow(digest=pa.array(names, pa.binary()), start=pa.array(begin, pa.int64()), end=pa.array(end, pa.int64()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digests, starts, parts = None, [], [], []
        for batch in batches:
            for bucket, digest, start, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != last and len(parts) >= slice_rows:
                    yield solve(digests, starts, parts)
                    digests, starts, parts = [], [], []
                last = bucket
                digests.append(digest)
                starts.append(start)
                parts.append(part)
        if parts:
            yield solve(digests, starts, parts)

    return rows.mapInArrow(spans, "digest binary, start long, end long")


def refine_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same with one row per window, counted by identifier: for buckets too large for a task."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, start, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, _ = _windows([part], length)
                yield _arrow(digest=pa.array([digest] * len(ids), pa.binary()),
                             start=pa.array(start + np.arange(len(ids)), pa.int64()), id=pa.array(ids.view(np.int64)))

    rows = contexts.select("digest", "start", "bytes").mapInArrow(windows, "digest binary, start long, id long")
    # Neighbouring anchors of a text see the same window; it counts once.
    rows = materialize(rows.distinct(), "hot-windows")
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    return rows.join(twice, "id").select("digest", "start", (F.col("start") + length).alias("end"))


def repeated_spans(df: DataFrame, length: int = 400, text: str = "text", hot: int = 6_000) -> DataFrame:
    """digest of the text, start, end of bytes to remove; spans of a text may touch and overlap."""
    texts = small_batches(df).select(F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    found = materialize(anchor_rows(texts, length), "anchors")
    around = found.groupBy("bucket", "outer").agg(F.count("*").alias("n"))
    shared = (around.groupBy("bucket").agg(F.sum("n").alias("c"), F.count("*").alias("m"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open"))
              .filter("c > 1").drop("c"))
    around = around.join(shared, "bucket")
    known = materialize(found.join(around, ["bucket", "outer"]), "shared-anchors")
    delete(found)

    # Surroundings of more than one place: repeated throughout, and one of the places stands for all.
    settled = known.filter("n > 1")
    back = length - length // 2
    first = (settled.filter("open > 0").groupBy("bucket", "outer", "m").agg(F.min(F.struct("digest", "pos")).alias("p"))
             .select("bucket", "m", "p.digest", "p.pos"))
    places = known.filter("n = 1 AND m > 1").select("bucket", "m", "digest", "pos").union(first)

    named = texts.select("text")
    wanted = places.groupBy("digest").agg(F.collect_list(F.struct("pos", "bucket", "m")).alias("places"))  # at most one per anchor of the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text_, list_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text_.encode("utf-8", "surrogatepass")
                pos = [p["pos"] for p in list_]
                yield _arrow(bucket=pa.array([p["bucket"] for p in list_], pa.int64()),
                             m=pa.array([p["m"] for p in list_], pa.int64()),
                             digest=pa.array([digest] * len(pos), pa.binary()),
                             start=pa.array([max(0, p - back) for p in pos], pa.int64()),
                             bytes=pa.array([raw[max(0, p - back):p + length] for p in pos], pa.binary()))

    texts_named = with_digest(named, "text").select("__digest", "text").dropDuplicates(["__digest"])
    contexts = (texts_named.join(wanted.hint("merge"), F.col("__digest") == F.col("digest")).select("digest", "text", "places")
                .mapInArrow(cut, "bucket long, m long, digest binary, start long, bytes binary"))
    contexts = materialize(contexts, "contexts")
    spans = refine(contexts.filter(F.col("m") <= hot), length)
    if not (large := contexts.filter(F.col("m") > hot)).isEmpty():
        spans = spans.union(refine_hot(large, length))
    whole = settled.select("digest", F.greatest(F.col("pos") - back, F.lit(0)).alias("start"), (F.col("pos") + length).alias("end"))
    return spans.union(whole.distinct())


def with_digest(df: DataFrame, text: str) -> DataFrame:
    @F.arrow_udf("binary")
    def digest(column: pa.Array) -> pa.Array:
        return pa.array([_digest(t.encode("utf-8", "surrogatepass")) for t in texts_of(column)], pa.binary())

    return small_batches(df).withColumn("__digest", digest(F.col(text)))


def without_repeats(df: DataFrame, length: int = 400, text: str = "text", hot: int = 6_000) -> DataFrame:
    """All rows of ``df`` with spans (ARRAY of start and end, in bytes, merged and sorted) and kept_bytes (BINARY).

    Every byte is removed that a ``length``-byte string covers which also starts anywhere else, in
    another row or the same; matches never cross rows, and are judged on the input.  Null texts are
    empty; texts shorter than ``length`` stay whole; of equal rows both are removed.  kept_bytes may cut a
    character in two, so it is binary.  An empty table gives an empty table; input columns named as the
    new ones give way.
    """
    df = plain(df, "spans", "kept_bytes")
    found = repeated_spans(df, length, text, hot)
    found = found.groupBy(F.col("digest").alias("__name")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))

    @F.arrow_udf("struct<spans: array<struct<start: bigint, end: bigint>>, kept_bytes: binary>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        spans, kept = [], []
        for text_, list_ in zip(texts_of(texts), lists.to_pylist()):
            raw, merged = text_.encode("utf-8", "surrogatepass"), []
            for a, b in sorted((s["start"], min(s["end"], len(raw))) for s in list_ or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            at, parts = 0, []
            for a, b in merged:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(parts))
        return pa.StructArray.from_arrays(
            [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["spans", "kept_bytes"])

    rows = with_digest(df, text).join(found.hint("merge"), F.col("__digest") == F.col("__name"), "left")
    return rows.withColumn("__cut", cut(F.col(text), F.col("__spans"))).select(*df.columns, "__cut.spans", "__cut.kept_bytes")
