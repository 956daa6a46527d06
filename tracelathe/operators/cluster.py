"""Density clustering (DBSCAN semantics) as joins over a grid.

Equal vectors become one weighted site.  Sites fall into cells whose diagonal is the radius, so
sites of one cell are neighbours by construction and are never paired.  Cells meet through a
coarser grid; a pair of cells whose bounding boxes are wholly inside or outside the radius is
settled by its boxes.  Sites are compared only where that leaves open whether they have enough
neighbours, or whether two clusters touch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tracelathe.operators import carry
from tracelathe.schema import EPS, MIN_POINTS
from tracelathe.session import materialize, spread

# Cells of a group that are paired without a grid: fewer pairs than the steps of a grid would make.
FEW_CELLS = 64


def _boxes(sites: DataFrame, keys: list[str], n_dims: int, *extra) -> DataFrame:
    return sites.groupBy(*keys, "cell").agg(
        F.array(*[F.min(F.col("v")[i]) for i in range(n_dims)]).alias("lo"),
        F.array(*[F.max(F.col("v")[i]) for i in range(n_dims)]).alias("hi"), *extra)


def _within(pairs: DataFrame, limit: float, n: int, a: tuple[str, str] = ("lo_a", "hi_a"), b: tuple[str, str] = ("lo_b", "hi_b")) -> DataFrame:
    """Pairs of boxes, given by their corners (a site is both corners of its own), that come within the radius, with
    ``whole``: whether all of them lie within it.  The corners are dropped.

    Worked in Arrow batches: written out for every dimension, the test is too long a method for the JVM to compile."""
    shown = [f for f in pairs.schema.fields if f.name not in {*a, *b}]
    names = [f.name for f in shown] + ["whole"]

    def tested(batches):
        for batch in batches:
            at = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in {*a, *b}}
            gap, span = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            with np.errstate(invalid="ignore", over="ignore"):
                for i in range(n):
                    (lo_a, hi_a), (lo_b, hi_b) = ([at[c][:, i] for c in side] for side in (a, b))
                    step = np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0.0)
                    gap += step * step
                    step = np.maximum(hi_a - lo_b, hi_b - lo_a)
                    span += step * step
                near, whole = gap <= limit, span <= limit
            columns = [batch.column(f.name) for f in shown] + [pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(near))

    return pairs.mapInArrow(tested, StructType([*shown, StructField("whole", BooleanType())]))


def _as(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def _near_cells(cells: DataFrame, keys: list[str], grid: list[int], limit: float, n: int, side: float) -> DataFrame:
    """Pairs of cells (both ways, self included) whose boxes come within the radius; ``whole`` if they are inside it throughout.
    ``at`` has the place in the grid where ``cell`` is but a number.

    Coarse cells span three fine ones: neighbours differ by at most one coarse step per dimension.  A cell asks only
    those around it that reach into its radius, and of each two opposite ones only one.  A group of few cells is
    one coarse cell.
    """
    cells = carry.salted_join(cells, cells.groupBy(*keys).agg((F.count("*") <= FEW_CELLS).alias("few")), keys, ["cell"])
    at = "at" if "at" in cells.columns else "cell"
    cells = cells.select(*keys, "cell", "lo", "hi", "few", *[
        F.when(F.col("few"), 0).otherwise(F.floor(F.get(at, F.lit(i)) / 3)).cast("bigint").alias(f"g{j}") for j, i in enumerate(grid)])
    a = cells.withColumns({"_ahead": F.lit(False), "_gap": F.lit(0.0)})
    width = 3 * side
    for j, i in enumerate(grid):
        steps = F.when(F.col("few"), F.array(F.lit(0))).when(F.col("_ahead"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
        lo, hi, g = F.get("lo", F.lit(i)), F.get("hi", F.lit(i)), F.col(f"g{j}")
        # Rounding moves a border by far less than this.
        slack = (F.abs(lo) + F.abs(hi)) * 1e-12
        gap = F.greatest(g * width - hi - slack, lo - (g + 1) * width - slack, F.lit(0.0))
        a = (a.withColumn("_s", F.explode(steps)).withColumn(f"g{j}", g + F.col("_s"))
             .withColumns({"_ahead": F.col("_ahead") | (F.col("_s") > 0), "_gap": F.when(F.col("few"), 0.0).otherwise(F.col("_gap") + gap * gap)})
             .where(F.col("_gap") <= limit * (1 + 1e-9)).drop("_s"))
    places = [f"g{j}" for j in range(len(grid))]
    a = a.select(*keys, *places, "_ahead", *[F.col(c).alias(f"{c}_a") for c in ("cell", "lo", "hi")])
    b = cells.select(*keys, *places, *[F.col(c).alias(f"{c}_b") for c in ("cell", "lo", "hi")])
    pairs = _within(a.join(b, [*keys, *places]).where(F.col("_ahead") | (F.col("cell_a") <= F.col("cell_b")))
                    .select(*keys, "cell_a", "cell_b", "lo_a", "hi_a", "lo_b", "hi_b"), limit, n)
    ends = lambda x, y: F.struct(F.col(x).alias("cell_a"), F.col(y).alias("cell_b"))
    both = F.when(F.col("cell_a") == F.col("cell_b"), F.array(ends("cell_a", "cell_b"))).otherwise(F.array(ends("cell_a", "cell_b"), ends("cell_b", "cell_a")))
    return pairs.select(*keys, F.explode(both).alias("_p"), "whole").select(*keys, "_p.*", "whole")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each ``cell`` with the smallest number reachable as its ``label``; ``edges`` (cell_a, cell_b) are stored.

    Every node with edges points to its smallest neighbour, if that is smaller; pointers jump until they all show roots, and
    edges between the same roots become one.  So the edges left shrink from round to round."""
    labels = nodes.select("cell", F.col("cell").alias("label"))
    jump = lambda df: carry.salted_join(
        df, df.select(F.col("label").alias("root"), F.col("root").alias("_further")), ["root"], ["label"]).select("label", F.col("_further").alias("root"))
    while not edges.isEmpty():
        both = edges.select("cell_a", "cell_b").unionByName(edges.select(F.col("cell_a").alias("cell_b"), F.col("cell_b").alias("cell_a")))
        roots = materialize(both.groupBy(F.col("cell_a").alias("label")).agg(F.least("cell_a", F.min("cell_b")).alias("root")), "roots")
        while True:
            jumped = materialize(jump(jump(roots)).join(roots.withColumnRenamed("root", "_was"), "label").select(
                "label", "root", (F.col("root") != F.col("_was")).alias("moved")), "roots")
            roots = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = carry.salted_join(labels, roots, ["label"], ["cell"], "left").select("cell", F.coalesce("root", "label").alias("label"))
        for end, other in (("cell_a", "cell_b"), ("cell_b", "cell_a")):
            edges = carry.salted_join(edges, roots.withColumnRenamed("label", end), [end], [other]).select(F.col("root").alias(end), other)
        edges = materialize(edges.where("cell_a <> cell_b").select(
            F.least("cell_a", "cell_b").alias("cell_a"), F.greatest("cell_a", "cell_b").alias("cell_b")).distinct(), "edges")
    return labels


def density_clusters(points: DataFrame, dims: list[str], keys=("test_id",), id_col="first_at",
                     name="descr", eps: float = EPS, min_points: int = MIN_POINTS,
                     grid: list[int] | None = None) -> DataFrame:
    """(keys, name, id, cluster_id) of all points that are no noise.

    Clusters are numbered from 0 by their earliest core point (by ``id_col``, unique within
    ``keys``); a border point joins the lowest-numbered cluster that reaches it.
    """
    keys, n_dims, limit = list(keys), len(dims), eps * eps
    side = eps / math.sqrt(n_dims) * (1 - 1e-12)
    grid = grid if grid is not None else list(range(min(3, n_dims)))
    vector: Column = F.array(*[F.col(d).cast("double") + 0.0 for d in dims])
    rows = points.select(*keys, name, F.col(id_col).alias("id"), vector.alias("v"))
    # Sites and cells are numbered: keys, ids and places don't travel with the pairs.
    found = materialize(rows.groupBy(*keys, "v").agg(F.count("*").alias("w"), F.min("id").alias("id"), F.min(name).alias("name"))
                        .withColumns({"at": F.transform("v", lambda x: F.floor(x / side).cast("bigint")), "site": F.monotonically_increasing_id()}), "sites")
    placed = found.withColumnRenamed("at", "cell")
    cells = spread(materialize(_boxes(placed, keys, n_dims, F.sum("w").alias("w")).withColumnRenamed("cell", "at")
                               .withColumn("cell", F.monotonically_increasing_id()), "cells"))
    sites = spread(materialize(found.join(cells.select(*keys, "at", "cell"), [*keys, "at"]).drop("at"), "located"))
    near = spread(materialize(_near_cells(cells, keys, grid, limit, n_dims, side).drop(*keys), "near-cells"))
    core = materialize(_core(sites, cells, near, limit, n_dims, min_points), "core")

    boxes = materialize(_boxes(core, keys, n_dims, F.min("id").alias("id")), "core-boxes")
    labels = materialize(_labels(core, boxes, near, limit, n_dims), "cell-labels")
    # Numbered in ranges: one group may hold any number of clusters.
    heads = labels.join(boxes.select(*keys, "cell", "id"), "cell").groupBy(*keys, "label").agg(F.min("id").alias("id"), F.lit(1).alias("_one"))
    numbers = (carry.with_running(carry.range_chunks(heads, [*keys, "id"], "cluster-heads"), keys, ["id"], "_one", "_no")
               .select("label", (F.col("_no") - 1).cast("int").alias("cluster_id")))
    numbered = materialize(carry.salted_join(labels, numbers, ["label"], ["cell"]).select("cell", "cluster_id"), "numbered")

    inner = core.join(numbered, "cell").select("site", "cluster_id")
    loose = sites.join(core.select("site"), "site", "left_anti").select("site", "v", "cell")
    reach = (_as(loose, "a").join(near, "cell_a").join(_as(numbered, "b"), "cell_b"))
    open_ = _within(reach.where("NOT whole").drop("whole").join(_as(boxes.select("cell", "lo", "hi"), "b"), "cell_b")
                    .select("site_a", "v_a", F.col("v_a").alias("_v"), "cell_b", "cluster_id_b", "lo_b", "hi_b"), limit, n_dims, ("_v", "_v"))
    facing = open_.where("NOT whole").drop("whole").join(_as(core.select("cell", "v"), "b"), "cell_b").select("site_a", "cluster_id_b", "v_a", "v_b")
    shown = ["site_a", "cluster_id_b"]
    touched = (reach.where("whole").select(*shown).unionByName(open_.where("whole").select(*shown))
               .unionByName(_within(facing, limit, n_dims, ("v_a", "v_a"), ("v_b", "v_b")).select(*shown)))
    border = touched.groupBy(F.col("site_a").alias("site")).agg(F.min("cluster_id_b").alias("cluster_id"))
    of_sites = materialize(inner.unionByName(border).join(sites.drop("cell"), "site"), "site-clusters")
    single = of_sites.where("w = 1").select(*keys, F.col("name").alias(name), F.col("id").alias(id_col), "cluster_id")
    # Points of equal vectors; all of them may be.
    shared = of_sites.where("w > 1").select(*keys, "v", "cluster_id")
    return single.unionByName(carry.salted_join(rows, shared, [*keys, "v"], ["id"]).select(*keys, name, F.col("id").alias(id_col), "cluster_id"))


def _core(sites: DataFrame, cells: DataFrame, near: DataFrame, limit: float, n_dims: int, min_points: int) -> DataFrame:
    """Sites with enough neighbours.  Boxes tell this of most cells as a whole; then boxes are held against the sites of
    the other cells, and sites against those that are still short of neighbours."""
    thin = cells.where(F.col("w") < min_points).select("cell")
    by_cell = (near.where("whole").join(_as(thin, "a"), "cell_a", "left_semi").join(_as(cells.select("cell", "w"), "b"), "cell_b")
               .groupBy(F.col("cell_a").alias("cell")).agg(F.sum("w_b").alias("_n")))
    few = materialize(thin.join(by_cell, "cell", "left").select("cell", F.coalesce("_n", F.lit(0)).alias("_n"))
                      .where(F.col("_n") < min_points), "thin-cells")
    lone = sites.join(few, "cell").select("site", "v", "cell", "_n")
    probe = materialize(_within(
        _as(lone, "a").join(near.where("NOT whole").drop("whole"), "cell_a").join(_as(cells.select("cell", "lo", "hi", "w"), "b"), "cell_b")
        .select("site_a", "v_a", F.col("v_a").alias("_v"), "cell_b", "w_b", "lo_b", "hi_b"), limit, n_dims, ("_v", "_v")), "probe")
    by_box = probe.where("whole").groupBy(F.col("site_a").alias("site")).agg(F.sum("w_b").alias("_boxed"))
    counted = materialize(lone.select("site", "_n").join(by_box, "site", "left")
                          .select("site", (F.col("_n") + F.coalesce("_boxed", F.lit(0))).alias("_n")), "counted")
    short = counted.where(F.col("_n") < min_points).select(F.col("site").alias("site_a"))
    facing = (probe.where("NOT whole").select("site_a", "v_a", "cell_b").join(short, "site_a", "left_semi")
              .join(_as(sites.select("cell", "v", "w"), "b"), "cell_b").select("site_a", "v_a", "v_b", "w_b"))
    by_site = (_within(facing, limit, n_dims, ("v_a", "v_a"), ("v_b", "v_b"))
               .groupBy(F.col("site_a").alias("site")).agg(F.sum("w_b").alias("_met")))
    enough = (counted.join(by_site, "site", "left").where(F.col("_n") + F.coalesce("_met", F.lit(0)) >= min_points).select("site"))
    return (sites.join(few.select("cell"), "cell", "left_anti")
            .unionByName(sites.join(few.select("cell"), "cell", "left_semi").join(enough, "site", "left_semi").select(*sites.columns)
                         ).drop("w", "name"))


def _labels(core: DataFrame, boxes: DataFrame, near: DataFrame, limit: float, n_dims: int) -> DataFrame:
    """Core cells (``cell``) with the smallest cell of their cluster (``label``).

    Cells whose boxes lie within the radius are linked first; sites are compared only between cells this leaves apart."""
    cells = boxes.select("cell")
    held = (near.where("cell_a < cell_b").join(_as(cells, "a"), "cell_a", "left_semi").join(_as(cells, "b"), "cell_b", "left_semi"))
    linked = materialize(_components(cells, materialize(held.where("whole").select("cell_a", "cell_b"), "edges")), "linked")
    ends = ["cell_a", "cell_b", "label_a", "label_b"]
    apart = (held.where("NOT whole").drop("whole").join(_as(linked, "a"), "cell_a").join(_as(linked, "b"), "cell_b")
             .where("label_a <> label_b"))
    corners = boxes.select("cell", "lo", "hi")
    pairs = materialize(_within(apart.join(_as(corners, "a"), "cell_a").join(_as(corners, "b"), "cell_b"), limit, n_dims).select(*ends, "whole"), "cell-pairs")
    points = core.select("cell", "v")
    facing = materialize(_within(
        pairs.where("NOT whole").drop("whole").join(_as(points, "a"), "cell_a").join(_as(corners, "b"), "cell_b")
        .withColumn("_v", F.col("v_a")), limit, n_dims, ("_v", "_v")), "facing")
    links = lambda df: df.select(F.col("label_a").alias("cell_a"), F.col("label_b").alias("cell_b"))
    sure = links(pairs.where("whole")).unionByName(links(facing.where("whole"))).distinct()
    sure = materialize(sure, "edges")
    close = (facing.where("NOT whole").drop("whole").join(sure.select(F.col("cell_a").alias("label_a"), F.col("cell_b").alias("label_b")), ["label_a", "label_b"], "left_anti")
             .join(_as(points, "b"), "cell_b").select("label_a", "label_b", "v_a", "v_b"))
    met = links(_within(close, limit, n_dims, ("v_a", "v_a"), ("v_b", "v_b")))
    joined = _components(linked.select(F.col("label").alias("cell")).distinct(), materialize(sure.unionByName(met).distinct(), "edges"))
    return carry.salted_join(linked, joined.select(F.col("cell").alias("label"), F.col("label").alias("_last")), ["label"], ["cell"]).select(
        "cell", F.col("_last").alias("label"))
