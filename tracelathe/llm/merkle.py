"""A Merkle manifest of a dataset: content-addressed records and proofs by descent from the root.

A row is a leaf.  Rows of one language make a tree, the trees' roots in the order of languages make
the tree above them, whose root names the whole dataset.  At every level each ``arity`` consecutive
nodes become the digest of their digests (the last run may be shorter, even one node).

A tree is cut by rank into segments of ``arity ** levels`` nodes.  A segment is solved in one task,
whatever the tree holds, and stored as records (digest -> digests of its children) under its own
root; the roots of a tier's segments are the nodes of the next tier, so a tree of 2^40 leaves has four
tiers.  A request for a leaf descends from the root: the digits of its rank choose a child at every
level, the children not chosen are collected, and segment follows segment down to the leaf.  Requests
that share a segment descend to it once, as one request of the tier above.  Reversed, the path is the
leaf's proof, bottom up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelathe.llm.common import materialize, small_batches

PATH = "array<struct<digit: int, others: string>>"
_RECORDS = "array<struct<digest: string, children: array<string>>>"
_SEGMENT = f"tree string, segment long, n long, root string, records {_RECORDS}"


class Manifest(NamedTuple):
    """leaves: tree, rank, n (leaves of the tree) and the columns given to ``build``; ``trees``: the segments of
    the languages' trees, tier by tier; ``roots``: tree, digest, height (tiers above the leaves); ``above`` and ``top``: the
    same for the tree of roots; arity and levels as built."""
    leaves: DataFrame
    trees: list[DataFrame]
    roots: DataFrame
    above: list[DataFrame]
    top: DataFrame
    arity: int
    levels: int


def digest(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the columns' fields after each other."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def tree_of(lang: Column) -> Column:
    """A name that sorts as the language does by its bytes, null before all."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def ranked(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with rank (from 0 along ``order``) and n (rows) within ``by``.  ``order`` begins with ``by``.

    Ranges of the order are sorted each in its own task; the places inside a range and one running
    count per (``by``, range) make the rank."""
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    cut = materialize(cut, name).withColumn("__part", F.shiftright("__at", 33))
    parts = cut.groupBy(by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    along = Window.partitionBy(by).orderBy("__part")
    parts = (parts.withColumn("__before", F.sum("__n").over(along) - F.col("__n"))
             .withColumn("n", F.sum("__n").over(Window.partitionBy(by))).drop("__n"))
    return (cut.join(parts, [by, "__part"]).withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first"))
            .drop("__at", "__part", "__before", "__first"))


def grow(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """From tree, rank, digest, n to the trees' segments by tier, and their roots (tree, digest, height)."""
    width = arity ** levels

    def solve(group: pa.Table) -> pa.Table:
        tree, segment, n = (group.column(c)[0].as_py() for c in ("tree", "segment", "n"))
        row = [d for _, d in sorted(zip(group.column("rank").to_pylist(), group.column("digest").to_pylist()))]
        records: dict[str, list[str]] = {}
        left = n
        for _ in range(levels):
            if left == 1:
                break
            runs = [row[i:i + arity] for i in range(0, len(row), arity)]
            row = [digest(*run) for run in runs]
            records.update(zip(row, runs))
            left = -(-left // arity)
        return pa.table({"tree": [tree], "segment": pa.array([segment], pa.int64()), "n": pa.array([n], pa.int64()), "root": row,
                         "records": pa.array([[{"digest": d, "children": c} for d, c in records.items()]],
                                             pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))})

    tiers, roots = [], []
    while True:
        roots.append(nodes.filter("n = 1").select("tree", "digest", F.lit(len(tiers)).alias("height")))
        nodes = nodes.filter("n > 1").select("tree", "rank", "digest", "n", F.expr(f"rank DIV {width}").alias("segment"))
        if nodes.isEmpty():
            return tiers, reduce(DataFrame.union, roots)
        tiers.append(materialize(nodes.groupBy("tree", "segment").applyInArrow(solve, _SEGMENT), "merkle-segments"))
        nodes = tiers[-1].select("tree", F.col("segment").alias("rank"), F.col("root").alias("digest"),
                                 F.expr(f"(n + {width - 1}) DIV {width}").alias("n"))


def build(leaves: DataFrame, arity: int = 2, levels: int = 10) -> Manifest:
    """The manifest of ``leaves``: tree (see ``tree_of``), doc_id, leaf, and any further columns.

    Leaves of a tree ascend by doc_id (nulls first), then by leaf, so rows of one id have a defined order and
    equal rows are leaves of their own.  An empty table gives a manifest without roots."""
    leaves = materialize(leaves.withColumn("__tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("__tie")]
    rows = ranked(leaves, "tree", order, "merkle-order").drop("__tie")
    trees, roots = grow(rows.select("tree", "rank", F.col("leaf").alias("digest"), "n"), arity, levels)
    tops = ranked(roots.select(F.lit("").alias("above"), "tree", "digest", "height"), "above", [F.col("above"), F.col("tree")], "merkle-roots")
    above, top = grow(tops.select(F.col("above").alias("tree"), "rank", "digest", "n"), arity, levels)
    return Manifest(rows, trees, tops, above, top, arity, levels)


def descend(tiers: list[DataFrame], starts: DataFrame, wanted: DataFrame, arity: int, levels: int) -> DataFrame:
    """Paths from roots to nodes: tree, rank, digest, path (top down, after that of ``starts``), carried, row.

    ``starts``: tree, height, digest, path, carried (a struct that every path of the tree brings along);
    ``wanted``: tree, rank, row (a struct)."""
    width = arity ** levels
    carried, row = starts.schema["carried"].dataType, wanted.schema["row"].dataType
    below = (starts.filter("height = 0").join(wanted.select("tree", "rank", "row"), "tree")
             .select("tree", "rank", "digest", "path", "carried", "row"))
    at = None
    for t in reversed(range(len(tiers))):
        here = starts.filter(F.col("height") == t + 1).select("tree", F.lit(0).cast("long").alias("segment"), "digest", "path", "carried")
        if at is not None:
            here = here.unionByName(at.select("tree", F.col("rank").alias("segment"), "digest", "path", "carried"))
        asked = wanted.select("tree", "rank", "row") if t == 0 else (
            wanted.select("tree", F.expr(f"rank DIV {width ** t}").alias("rank")).distinct().withColumn("row", F.lit(None).cast(row)))
        # At most as many as a segment has nodes.
        asked = (asked.groupBy("tree", F.expr(f"rank DIV {width}").alias("segment"))
                 .agg(F.collect_list(F.struct("rank", "row")).alias("asked")))
        records = tiers[t].select("root", "records").dropDuplicates(["root"])  # equal digests hold equal records
        rows = (here.join(asked, ["tree", "segment"]).join(records.hint("merge"), F.col("digest") == F.col("root"))
                .select("tree", "root", "path", "carried", "asked", "records"))
        at = small_batches(rows).mapInArrow(_chosen(arity, width), f"tree string, rank long, digest string, path {PATH}, "
                                                                   f"carried {carried.simpleString()}, row {row.simpleString()}")
    return below if at is None else below.unionByName(at)


def _chosen(arity: int, width: int):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.schema
            for k in range(batch.num_rows):
                tree, root, path, records = (batch.column(c)[k].as_py() for c in ("tree", "root", "path", "records"))
                children = {r["digest"]: r["children"] for r in records}
                depth, node = 0, root
                while node in children and depth < 64:  # all leaves of a segment are equally deep
                    node, depth = children[node][0], depth + 1
                asked = batch.column("asked")[k].values
                ranks, found, out = asked.field("rank").to_pylist(), [], []
                for rank in ranks:
                    place, node, steps = rank % width, root, []
                    for level in reversed(range(depth)):
                        digit, below = place // arity ** level % arity, children[node]
                        steps.append({"digit": digit, "others": "".join(below[:digit] + below[digit + 1:])})
                        node = below[digit]
                    found.append(node)
                    out.append(path + steps)
                n = len(ranks)
                carried = pa.array([batch.column("carried")[k].as_py()] * n, types.field("carried").type)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n), pa.array(ranks, pa.int64()), pa.array(found),
                                                  pa.array(out, types.field("path").type), carried, asked.field("row")],
                                                 ["tree", "rank", "digest", "path", "carried", "row"])

    return paths


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Per requested leaf (default: all): the leaf's columns, subroot, root, and proof.

    ``requests`` are rows of ``manifest.leaves``.  proof is an array, bottom up, of digit (the node's place in its
    run) and others (the run's other digests after each other, '' where the node is alone)."""
    requests = manifest.leaves if requests is None else requests
    names = [c for c in requests.columns if c not in ("tree", "rank", "n")]
    top = manifest.top.select("tree", "height", "digest", F.array().cast(PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("carried"))
    heads = manifest.roots.select(F.lit("").alias("tree"), "rank", F.struct("tree", "height", "digest").alias("row"))
    heads = descend(manifest.above, top, heads, manifest.arity, manifest.levels)
    starts = heads.select("row.tree", "row.height", "row.digest", "path", F.struct("carried.root", F.col("row.digest").alias("subroot")).alias("carried"))
    wanted = requests.select("tree", "rank", F.struct(*names).alias("row"))
    found = descend(manifest.trees, starts, wanted, manifest.arity, manifest.levels)
    return found.select("tree", "rank", "row.*", "carried.subroot", "carried.root", F.reverse("path").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["others"]), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    @F.arrow_udf("string")
    def folded(leaves: pa.Array, paths: pa.Array) -> pa.Array:
        steps, at, out = paths.flatten(), 0, []
        digits, others = steps.field("digit").to_pylist(), steps.field("others").to_pylist()
        for node, n in zip(leaves.to_pylist(), paths.value_lengths().to_pylist()):
            for k in range(at, at + n):
                cut = 64 * digits[k]
                node = hashlib.sha256((others[k][:cut] + node + others[k][cut:]).encode()).hexdigest()
            at += n
            out.append(node)
        return pa.array(out, pa.string())

    return folded(leaf, proof)


def audit(df: DataFrame, tampered: Column, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
          text: str = "text", arity: int = 2, levels: int = 10) -> DataFrame:
    """Per row of ``df``: doc_id, leaf, subroot, root, proof, folded_root, verified.

    The manifest and the proofs are those of ``df``.  Where ``tampered`` (BOOLEAN, null: false) holds, n_chars is then taken as one
    more (null stays null), and folded_root is recomputed from that leaf and the original siblings; verified tells whether it is the root.
    Nulls in any column are fields of their own; other columns of ``df`` are not read.  Every row gives a row,
    repeated ones too, whose order decides nothing; an empty table gives an empty table."""
    columns = [F.col(c) for c in (doc_id, source, lang, n_chars, text)]
    changed = [F.col(doc_id), F.col(source), F.col(lang), F.col(n_chars).cast("long") + 1, F.col(text)]
    leaves = df.select(tree_of(F.col(lang)).alias("tree"), F.col(doc_id).cast("long").alias("doc_id"), leaf(*columns).alias("leaf"),
                       F.when(tampered, leaf(*changed)).alias("changed"))
    out = proofs(build(leaves, arity, levels))
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
