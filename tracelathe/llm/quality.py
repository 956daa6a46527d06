"""Quality classifier: a linear support vector machine over Naive Bayes features.

Features say which byte n-grams a text holds (hashed to a fixed number of places), and how often its
pairs of neighbouring words recur.  Each is scaled by the log-ratio of its smoothed shares in the two
classes, a document's features by their norm; a hinge-loss model is fitted by dual coordinate descent.
Margins become probabilities through a logistic curve in margin and length (a short text's margin says
less), fitted on margins of folds that the model hasn't seen, weighted to the classes' shares in all
training labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import plain, small_batches, texts_of

PLACES_BITS = 18
PLACES = 1 << PLACES_BITS


def _place(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


class Grams:
    """The distinct places of a text's n-grams and of its repetition, in time linear in its length."""

    def __init__(self, sizes: tuple[int, ...] = (1, 2, 3, 4)):
        self.sizes, self.stamp = sizes, np.zeros(PLACES, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        found = [self.repetition(text)]
        code = np.zeros(len(data), np.uint64)
        for k in range(max(self.sizes)):
            if len(data) <= k:
                break
            code = (code[:len(data) - k] << np.uint64(8)) | data[k:]
            if k + 1 in self.sizes:
                found.append(_place(code + np.uint64(k << 40)))
        at = np.concatenate(found)
        order = np.arange(len(at))
        self.stamp[at] = order
        return at[self.stamp[at] == order]


    @staticmethod
    def repetition(text: str) -> np.ndarray:
        """Two indicators: the share of words that repeat the one before, and that of distinct pairs
        of neighbours, by the number of words.  None for texts of fewer than two words."""
        words = text.split()
        pairs = len(words) - 1
        if pairs < 1:
            return np.zeros(0, np.int64)
        same = sum(map(eq, words, words[1:])) / pairs
        distinct = len(set(zip(words, words[1:]))) / pairs
        return _place(np.array([int(10 * same), 64 + 16 * min(9, int(10 * distinct)) + min(15, len(words).bit_length())], np.uint64) + np.uint64(1 << 50))


def log_ratios(features: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    share = []
    for label in (1, -1):
        count = np.full(PLACES, smoothing)
        for f, label_ in zip(features, y):
            if label_ == label:
                count[f] += 1
        share.append(count / count.sum())
    return np.log(share[0] / share[1])


def descend(features: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; weights per place (scaled back by
    the ratios) and bias."""
    rows = [ratios[f] / max(np.linalg.norm(ratios[f]), 1e-12) for f in features]
    w, bias, alpha, rng = np.zeros(PLACES), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, x = features[i], rows[i]
            slope = y[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / (x @ x + 1.0), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def margins(features: list[np.ndarray], ratios: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[f] @ ratios[f] / max(np.linalg.norm(ratios[f]), 1e-12) + bias for f in features])


def terms(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the logistic curve is linear in: margin, length (in distinct features), both, one."""
    length = np.log1p(size) - 6.5
    return np.stack([m, length, m * length, np.ones_like(m)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """theta of P(1) = 1 / (1 + exp(-x theta)), by damped Newton steps."""
    target, theta = (y > 0).astype(float), np.eye(x.shape[1])[0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        gradient = x.T @ (weight * (p - target)) + 1e-2 * theta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return theta


def fit(features: list[np.ndarray], y: np.ndarray, class_totals: tuple[float, float], cost: float = 1.0, epochs: int = 8, folds: int = 4):
    """Weights (float32 per place, ratios included), ratios, bias, theta."""
    held = np.zeros(len(y))
    part = np.arange(len(y)) % folds
    for k in range(folds):
        a = np.flatnonzero(part != k)
        own = [features[i] for i in a]
        r = log_ratios(own, y[a])
        w, bias = descend(own, r, y[a], cost, epochs)
        b = np.flatnonzero(part == k)
        held[b] = margins([features[i] for i in b], r, w, bias)
    weight = np.where(y > 0, class_totals[1] / max(1, (y > 0).sum()), class_totals[0] / max(1, (y < 0).sum()))
    size = np.array([len(f) for f in features])
    theta = logistic(terms(held, size), y, weight * len(y) / weight.sum())
    ratios = log_ratios(features, y)
    w, bias = descend(features, ratios, y, cost, epochs)
    return (w * ratios).astype("<f4"), ratios.astype("<f4"), bias, theta


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500) -> tuple | None:
    """The model from labelled rows, ``per_class`` of each class (those of the least hash of the id);
    None where a class is missing.  Nulls in labels and ids teach nothing."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").distinct()
    totals = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    if len(totals) < 2:
        return None
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = known.filter("__label = 0").orderBy(*order).limit(per_class).union(known.filter("__label = 1").orderBy(*order).limit(per_class))
    rows = df.join(F.broadcast(chosen), df[doc_id] == F.col("__id"))  # 2 x per_class rows

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            found = [grams(t).astype(np.int32) for t in texts_of(batch)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    def model(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "label"])
        y = np.where(group["label"].to_numpy() == 1, 1, -1)
        w, r, bias, theta = fit([np.asarray(f) for f in group["places"]], y, (totals[0], totals[1]))
        return pd.DataFrame({"w": [w.tobytes()], "r": [r.tobytes()], "bias": [bias], "theta": [theta.tolist()]})

    sample = small_batches(rows).select(F.col("__id").alias("id"), F.col("__label").alias("label"), places(F.col(text)).alias("places"))
    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(model, "w binary, r binary, bias double, theta array<double>").head()
    return None if got is None else (np.frombuffer(got["w"], "<f4"), np.frombuffer(got["r"], "<f4"), got["bias"], np.array(got["theta"]))


def score(text: Column, model: tuple | None) -> Column:
    """Probability of label 1 (DOUBLE); null texts count as empty; 0.5 for all without a model."""
    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        w, r, bias, theta = model
        for batch in batches:
            out = []
            for t in texts_of(batch):
                f = grams(t)
                out.append((float(w[f].sum()) / max(float(np.sqrt((r[f].astype(float) ** 2).sum())), 1e-12) + bias, len(f)))
            m, size = np.array(out, float).reshape(-1, 2).T
            yield pa.array(1 / (1 + np.exp(-np.clip(terms(m, size) @ theta, -35, 35))), pa.float64())

    return probability(text) if model else F.lit(0.5)


def with_quality(df: DataFrame, model: tuple | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``df`` with score and predicted (1 if score >= ``threshold``).  Every row is kept, an empty
    table gives an empty table; input columns named as the new ones give way."""
    df = plain(small_batches(df), "score", "predicted")
    return df.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
