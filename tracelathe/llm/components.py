"""Connected components of a graph by alternating large-star and small-star steps.

Every step keeps the components and brings the graph nearer to one star around the smallest node
of each; about log(n) rounds are needed, whatever the shape.  A node's neighbours are only ever
reduced to their smallest (combined before the shuffle) and joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import delete, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (one node per component) for every node of ``edges``; keys of any type.
    Self-loops and repeated edges do no harm; no edges give no rows."""
    ends = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    nodes = materialize(ends.withColumn("id", F.monotonically_increasing_id()), "nodes")
    graph = (edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
             .join(nodes.select(F.col("node").alias("__a"), F.col("id").alias("u")), "__a")
             .join(nodes.select(F.col("node").alias("__b"), F.col("id").alias("v")), "__b")
             .filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    graph = materialize(graph, "star")
    mark = _mark(graph)
    while True:
        both = graph.union(graph.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # in (u, v) always u > v
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        small = materialize(small, "star")
        before, mark = mark, _mark(small)
        delete(graph)
        delete(large)
        graph = small
        if mark == before:
            break
    root = nodes.select(F.col("id").alias("v"), F.col("node").alias("root"))
    star = nodes.join(graph, nodes["id"] == graph["u"], "left").select("node", F.coalesce("v", "id").alias("v"))
    return star.join(root, "v").select("node", "root")


def _mark(graph: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(graph.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())
