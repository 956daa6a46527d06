"""Near-duplicate groups by one-permutation MinHash.

1. One hash per word shingle; the range of hashes is cut into bins and each bin keeps its least
   value.  An empty bin borrows from a bin that a fixed hash of (bin, attempt) picks, until a
   filled one is met: optimal densification, so that short texts keep unbiased signatures.
2. Groups of bins (bands) are buckets.  Equal shingle sets count once.  Every bucket has a hub,
   the member that meets most others over all bands, and only edges from member to hub are made:
   at most one edge per member and band, however large a bucket is.
3. Edges are confirmed on full shingle sets.
4. Two members may be linked though one of them isn't linked with the hub.  So in the star of a
   hub, every member that the hub didn't confirm is compared with all others of the star, in
   blocks of bounded size inside tasks, and only links that join something new come out.
5. Confirmed links make components.

A star takes (members the hub didn't confirm) x (members) comparisons; a group of copies that all
match their hub takes none.  Bands of 5 of 125 bins miss a pair of similarity 0.85 about once in
two million, and one of 0.8 once in 20 000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import delete, longs, materialize, plain, small_batches, texts_of
from tracelathe.llm.components import components

BANDS, ROWS = 25, 5
_BINS = BANDS * ROWS
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII separators only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
    return np.unique(out)


_BOUNDS = (np.arange(_BINS + 1, dtype=np.float64) * (2.0**64 / _BINS)).astype(np.float64)
_EDGES = np.array([min(int(b), 2**64 - 1) for b in _BOUNDS], np.uint64)
_PICKS = (_mix(np.arange(_BINS * 512, dtype=np.uint64) + np.uint64(7)) % np.uint64(_BINS)).astype(np.int64).reshape(_BINS, 512)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band of a non-empty sorted hash set."""
    at = np.searchsorted(hashes, _EDGES)
    filled = at[1:] > at[:-1]
    filled[-1] |= bool(hashes[-1] == _TOP)
    value = _mix(hashes[np.minimum(at[:-1], len(hashes) - 1)])
    if not filled.all():
        source = np.arange(_BINS)
        empty = np.flatnonzero(~filled)
        for attempt in range(_PICKS.shape[1]):
            pick = _PICKS[empty, attempt]
            hit = filled[pick]
            source[empty[hit]] = pick[hit]
            empty = empty[~hit]
            if not len(empty):
                break
        source[empty] = np.flatnonzero(filled)[0]
        value = value[source]
    rows, key = value.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.astype(np.int64)


def _set_key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def signatures(text: Column, size: int) -> Column:
    """STRUCT<n_shingles BIGINT, set_key BINARY, bands ARRAY<BIGINT>> of each text."""
    @F.arrow_udf("struct<n_shingles: bigint, set_key: binary, bands: array<bigint>>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_hashes(t, size) for t in texts_of(batch)]
            bands = [band_keys(h) if len(h) else np.zeros(0, np.int64) for h in sets]
            yield pa.StructArray.from_arrays(
                [pa.array([len(h) for h in sets], pa.int64()), pa.array([_set_key(h) for h in sets], pa.binary()),
                 longs(bands).cast(pa.list_(pa.int64()))], ["n_shingles", "set_key", "bands"])

    return make(text)


def shingle_sets(text: Column, size: int) -> Column:
    """STRUCT<set_key BINARY, shingles ARRAY<BIGINT>> of each text, sorted.

    Marked nondeterministic (it isn't), which keeps Spark from working it out a second time, for all
    texts, to test its result for null before a join."""
    @F.arrow_udf("struct<set_key: binary, shingles: array<bigint>>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_hashes(t, size) for t in texts_of(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([_set_key(h) for h in sets], pa.binary()),
                 longs([h.astype(np.int64) for h in sets]).cast(pa.list_(pa.int64()))], ["set_key", "shingles"])

    return make.asNondeterministic()(text)


def star_edges(bands: DataFrame) -> DataFrame:
    """From (set_key, band) to distinct edges (m, h) between the members of a bucket and its hub."""
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(bands.join(shared, "band"), "bands")
    degree = shared.groupBy("set_key").agg(F.sum("n").alias("degree"))
    # Equal ranks make two hubs in a bucket: more edges, no harm.
    rank = F.shiftleft(F.least("degree", F.lit(2**31 - 1)), 32) + F.crc32("set_key")
    ranked = shared.join(degree, "set_key").select("set_key", "band", rank.alias("rank"))
    hubs = (ranked.join(ranked.groupBy("band").agg(F.max("rank").alias("rank")), ["band", "rank"])
            .select("band", F.col("set_key").alias("h")))
    edges = (shared.select("band", F.col("set_key").alias("m")).join(hubs, "band").filter("m <> h")
             .select("m", "h").distinct())
    edges = materialize(edges, "edges")
    delete(shared)
    return edges


def _star_links(sets: list[np.ndarray], confirmed: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links that join unconfirmed members with any other, as a spanning forest; confirmed members
    are joined already (through their hub)."""
    n = len(sets)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined = np.flatnonzero(confirmed).tolist()
    for j in joined[1:]:
        parent[j] = joined[0]
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(code, kind="stable")
    posting, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    start, out = np.concatenate([[0], np.cumsum(size)]), []
    for i in np.flatnonzero(~confirmed).tolist():
        mine = code[start[i]:start[i + 1]]
        counts = np.bincount(np.concatenate([posting[first[c]:first[c + 1]] for c in mine]), minlength=n)
        linked = 100 * counts >= share * (size + size[i] - counts)
        for j in np.flatnonzero(linked).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def rest_links(stars: DataFrame, share: int) -> DataFrame:
    """From rows (star, task, m, confirmed, shingles) to links (a, b) within each star and task."""
    rows = stars.repartition("star", "task").sortWithinPartitions("star", "task")

    def solve(names, confirmed, sets) -> pa.RecordBatch:
        links = _star_links(sets, np.array(confirmed, bool), share) if len(sets) > 1 else []
        return pa.RecordBatch.from_pydict({"a": pa.array([names[i] for i, _ in links], pa.binary()),
                                           "b": pa.array([names[j] for _, j in links], pa.binary())})

    def per_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, confirmed, sets = None, [], [], []
        for batch in batches:
            stars_, tasks, members = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            flags, lists = batch.column(3).to_pylist(), batch.column(4)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for r, now in enumerate(zip(stars_, tasks)):
                if now != key:
                    if names:
                        yield solve(names, confirmed, sets)
                    key, names, confirmed, sets = now, [], [], []
                names.append(members[r])
                confirmed.append(flags[r])
                sets.append(flat[ends[r]:ends[r + 1]].copy())
        if names:
            yield solve(names, confirmed, sets)

    return rows.select("star", "task", "m", "confirmed", "shingles").mapInArrow(per_star, "a binary, b binary")


def _tasks(block: int):
    """Splits a star of more than ``block`` members into blocks, and lists the tasks of each row:
    unconfirmed blocks meet each other and all confirmed blocks; confirmed ones don't meet."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    deal = lambda n: F.pmod(F.hash("m"), F.greatest(blocks(n), F.lit(1)))
    one = F.col("n_rest") + F.col("n_confirmed") <= block
    rest = F.transform(F.sequence(F.lit(0), blocks("n_rest") + blocks("n_confirmed") - 1),
                       lambda k: F.when(k < blocks("n_rest"), F.format_string("%d-%d", F.least(k, deal("n_rest")), F.greatest(k, deal("n_rest"))))
                       .otherwise(F.format_string("%d-c%d", deal("n_rest"), k - blocks("n_rest"))))
    confirmed = F.transform(F.sequence(F.lit(0), blocks("n_rest") - 1), lambda k: F.format_string("%d-c%d", k, deal("n_confirmed")))
    return F.when(one, F.array(F.lit("all"))).when(F.col("confirmed"), confirmed).otherwise(rest)


def near_groups(df: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text",
                block: int = 1024) -> DataFrame:
    """Per row of ``df``: doc_id, text_key (md5 of the text), n_shingles, group, component_id, kept.

    Documents of ``size``-word shingle sets A and B are linked when 100 |A and B| >= ``share``
    |A or B|; component_id is the smallest doc_id reachable.  Null texts and texts without words
    are linked with nothing: component_id is their own id.  Repeated rows keep their rows and share a
    component.  An empty table gives an empty table.
    """
    source = small_batches(df).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    text_key = F.md5(F.coalesce("text", F.lit("")))
    docs = materialize(source.select("doc_id", text_key.alias("text_key"), signatures(F.col("text"), size).alias("s"))
                       .select("doc_id", "text_key", "s.*"), "signatures")
    edges = star_edges(docs.select("set_key", F.explode("bands").alias("band")).distinct())

    wanted = edges.select(F.col("m").alias("set_key")).union(edges.select(F.col("h").alias("set_key"))).distinct()
    ids = docs.join(wanted, "set_key").groupBy("set_key").agg(F.min("doc_id").alias("id")).select("id").distinct()
    sets = (source.join(ids.hint("merge"), source["doc_id"].eqNullSafe(ids["id"]), "left_semi")
            .select(shingle_sets(F.col("text"), size).alias("s")).select("s.*")
            .join(wanted, "set_key", "left_semi").dropDuplicates(["set_key"]))
    sets = materialize(sets, "sets")
    of = lambda name, key: sets.select(F.col("set_key").alias(key), F.col("shingles").alias(name)).hint("merge")
    common = F.size(F.array_intersect("x", "y"))
    confirmed = 100 * common >= share * (F.size("x") + F.size("y") - common)
    tried = materialize(edges.join(of("x", "m"), "m").join(of("y", "h"), "h")
                        .select("m", "h", confirmed.alias("confirmed")), "tried")

    stars = (tried.groupBy("h").agg(F.count_if(~F.col("confirmed")).alias("n_rest"), F.count_if("confirmed").alias("n_confirmed"))
             .filter("n_rest > 0 AND n_rest + n_confirmed > 1"))
    members = (tried.join(stars, "h").withColumn("task", F.explode(_tasks(block)))
               .join(of("shingles", "m"), "m").withColumnRenamed("h", "star"))
    links = rest_links(members, share).union(tried.filter("confirmed").select("m", "h"))
    roots = components(materialize(links, "links")).withColumnRenamed("node", "set_key")

    grouped = docs.drop("bands").join(roots, "set_key", "left").withColumn("group", F.coalesce("root", "set_key"))
    least = grouped.filter("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, "group", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "text_key", "n_shingles", "group", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(df: DataFrame, size: int = 5, share: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each near-duplicate group: that of the smallest doc_id; of several
    rows with that id one, by text.  Rows without words all stay, but for repeated (doc_id, text)."""
    groups = near_groups(df, size, share, doc_id, text).filter("kept")
    chosen = (groups.filter("n_shingles > 0").groupBy("group", "component_id").agg(F.min("text_key").alias("text_key"))
              .select("component_id", "text_key")
              .union(groups.filter("n_shingles = 0").select("doc_id", "text_key").distinct()).distinct()
              .select(F.col("component_id").alias("__id"), F.col("text_key").alias("__key")))
    # The same for rows that equal each other in id and text: how many, so that only those are sorted.
    repeated = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("__n")).withColumnsRenamed({"doc_id": "__i", "text_key": "__k"})
    chosen = (chosen.join(repeated, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k")))
              .select("__id", "__key", "__n"))
    chosen = materialize(chosen, "near-chosen")
    rows = (df.withColumn("__text_key", F.md5(F.coalesce(text, F.lit(""))))
            .join(chosen.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))))
    if not chosen.filter("__n > 1").isEmpty():  # only then are texts stored a second time
        rows = materialize(rows, "near-kept")
        rows = rows.filter("__n = 1").unionByName(rows.filter("__n > 1").dropDuplicates(["__id", "__key"]))
    return plain(rows, "__text_key", "__id", "__key", "__n")
