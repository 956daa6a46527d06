"""Isolation forest per group: bounded samples grow trees, rows are scored in salted groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracelathe.operators.quantiles import exact_quantiles
from tracelathe.operators import carry
from tracelathe.schema import CONTAMINATION, MAX_SAMPLES, N_TREES, SEED
from tracelathe.session import by_group, materialize

_SCORE_ROWS = 20_000     # rows scored together in one group
_CANDIDATES = 600        # expected draws per tree from which MAX_SAMPLES are taken
_EULER = 0.5772156649015329


def path_norm(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _grow(x: np.ndarray, tree: np.ndarray, depth_limit: int, rng) -> dict:
    """Grow all trees of a group level by level.  Nodes use heap numbers (children 2i, 2i+1)."""
    node = np.ones(len(x), dtype=np.int64)
    parts = []
    for depth in range(depth_limit + 1):
        if not len(x):
            break
        order = np.lexsort((node, tree))
        x, tree, node = x[order], tree[order], node[order]
        first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])])
        size = np.diff(np.r_[first, len(x)])
        lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        usable = hi > lo
        split = usable.any(axis=1) & (depth < depth_limit)
        feature = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        pick = np.arange(len(first)), feature
        cut = lo[pick] + rng.random(len(first)) * (hi[pick] - lo[pick])
        cut = np.where(cut >= hi[pick], lo[pick], cut)
        parts.append((tree[first], node[first], np.where(split, feature, -1), np.where(split, cut, 0.0), size))
        of = np.repeat(np.arange(len(first)), size)
        right = x[np.arange(len(x)), feature[of]] > cut[of]
        keep = split[of]
        x, tree, node = x[keep], tree[keep], (2 * node + right)[keep]
    return {k: np.concatenate([p[i] for p in parts])
            for i, k in enumerate(("tree", "node", "feature", "cut", "size"))}


def _score(x: np.ndarray, nodes: dict, n_trees: int, m: int) -> np.ndarray:
    """2^(-mean path / norm) per row; rows walk all trees together."""
    width = int(nodes["node"].max()) + 1
    feature = np.full((n_trees, width), -1, dtype=np.int64)
    cut, size = np.zeros((n_trees, width)), np.ones((n_trees, width))
    at = nodes["tree"], nodes["node"]
    feature[at], cut[at], size[at] = nodes["feature"], nodes["cut"], nodes["size"]
    t = np.arange(n_trees)
    node = np.ones((len(x), n_trees), dtype=np.int64)
    depth = np.zeros((len(x), n_trees))
    rows = np.arange(len(x))[:, None]
    while True:
        f = feature[t, node]
        inside = f >= 0
        if not inside.any():
            break
        right = x[rows, np.maximum(f, 0)] > cut[t, node]
        node = np.where(inside, 2 * node + right, node)
        depth += inside
    path = (depth + path_norm(size[t, node])).mean(axis=1)
    return np.power(2.0, -path / max(float(path_norm(m)), 1e-300)) if m > 1 else np.full(len(x), 0.5)


def sample_rows(rows: DataFrame, keys: list[str], ids: list[str], n_trees: int, seed: int) -> DataFrame:
    """A hash-drawn sample per tree.  Rows that no tree draws are dropped before the shuffle; in a
    group of at most ``MAX_SAMPLES`` rows each stands for all trees (tree -1)."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = carry.salted_join(rows, sizes, keys, ids)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_tree"), *ids), F.lit(1 << 52)) / F.lit(float(1 << 52))
    small = F.col("_n") <= MAX_SAMPLES
    trees = F.when(small, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    return (sized.withColumn("_tree", F.explode(trees)).withColumn("_draw", draw)
            .where(small | (F.col("_draw") < F.lit(float(_CANDIDATES)) / F.col("_n"))))


def isolation_forest(rows: DataFrame, keys: list[str], ids: list[str], dims: list[str],
                     n_trees: int = N_TREES, seed: int = SEED) -> DataFrame:
    """One row per group holding its trees as arrays (tree, node, feature, cut, size) and ``m``.

    A group hands at most about ``_CANDIDATES`` rows per tree to its task, however large it is.
    """
    drawn = sample_rows(rows.select(*keys, *ids, *[F.col(d).cast("double").alias(d) for d in dims]),
                        keys, ids, n_trees, seed)
    schema = (drawn.select(*keys).schema.simpleString()[len("struct<"):-1]
              + ",tree:array<int>,node:array<int>,feature:array<int>,cut:array<double>,"
                "size:array<int>,m:int,n_trees:int")
    n_keys = len(keys)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_tree", "_draw", *ids], kind="stable")
        pdf = pdf.groupby("_tree", sort=False).head(MAX_SAMPLES)
        x, tree = pdf[dims].to_numpy(dtype=float), pdf["_tree"].to_numpy(dtype=np.int64)
        if tree[0] < 0:
            x, tree = np.tile(x, (n_trees, 1)), np.repeat(np.arange(n_trees), len(pdf))
        m = int(np.bincount(tree).max())
        rng = np.random.default_rng([seed, *"|".join(map(str, key)).encode()])
        out = _grow(x, tree, max(1, math.ceil(math.log2(max(m, 2)))), rng)
        return pd.DataFrame([[*key[:n_keys], *[out[c].tolist() for c in ("tree", "node", "feature", "cut", "size")],
                              m, n_trees]],
                            columns=[*keys, "tree", "node", "feature", "cut", "size", "m", "n_trees"])

    return by_group(drawn, keys).groupBy(*keys).applyInPandas(grow, schema)


def forest_nodes(forest: DataFrame, keys: list[str]) -> DataFrame:
    """The trees as a node table, for storing or reading."""
    return (forest.select(*keys, "m", F.explode(F.arrays_zip("tree", "node", "feature", "cut", "size")).alias("_z"))
            .select(*keys, "m", "_z.*"))


def forest_scores(rows: DataFrame, forest: DataFrame, keys: list[str], ids: list[str],
                  dims: list[str]) -> DataFrame:
    """Anomaly score per row.  Rows of a large group are spread over salts, each with the trees."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / _SCORE_ROWS).cast("int").alias("_salts"))
    spread = (carry.salted_join(rows, sizes, keys, ids)
              .select(*keys, *ids, *[F.col(d).cast("double").alias(d) for d in dims],
                      F.pmod(F.xxhash64(*ids), F.col("_salts")).cast("int").alias("_part")))
    trees = (forest.join(sizes, keys)
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))
    schema = spread.select(*keys, *ids).schema.simpleString()[len("struct<"):-1] + ",score:double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*keys, *ids, "score"])
        f = right.iloc[0]
        nodes = {c: np.asarray(f[c]) for c in ("tree", "node", "feature", "cut", "size")}
        x = left[dims].to_numpy(dtype=float)
        step = max(1, 2_000_000 // int(f["n_trees"]) // 8)
        parts = [_score(x[i:i + step], nodes, int(f["n_trees"]), int(f["m"])) for i in range(0, len(x), step)]
        return left[[*keys, *ids]].assign(score=np.concatenate(parts))

    parts = [*keys, "_part"]
    return (by_group(spread, parts).groupBy(*parts).cogroup(by_group(trees, parts).groupBy(*parts))
            .applyInPandas(score, schema))


def forest_flags(scores: DataFrame, keys: list[str], contamination: float = CONTAMINATION,
                 anomaly_type="value_distribution") -> DataFrame:
    """Rows whose normality (-score) lies below the contamination percentile of their group;
    confidence is how far below."""
    normal = scores.withColumn("normality", -F.col("score"))
    cut = exact_quantiles(normal, keys, "normality", {"_offset": contamination})
    return (normal.join(cut, keys).where(F.col("normality") < F.col("_offset"))
            .withColumn("anomaly_type", F.lit(anomaly_type))
            .withColumn("confidence", F.col("_offset") - F.col("normality"))
            .drop("normality", "_offset", "score"))


def flag_anomalies(vectors: DataFrame, keys: list[str], ids: list[str], dims: list[str],
                   anomaly_type="value_distribution", **kw) -> DataFrame:
    """Standardised vectors in, flagged rows out."""
    forest = isolation_forest(vectors, keys, ids, dims, **kw)
    scores = materialize(forest_scores(vectors, forest, keys, ids, dims), "scores")
    return forest_flags(scores, keys, anomaly_type=anomaly_type)
