"""Run embeddings: TF-IDF over register path pieces, then principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tracelathe.operators import carry
from tracelathe.operators.text import corpus_weights, stop_words
from tracelathe.schema import CORPUS_VOCABULARY, PCA_DIMS, PIECE
from tracelathe.session import materialize


def path_pieces(access: DataFrame, chunk_lines=None) -> DataFrame:
    """Pieces of each run's descriptions as if these were joined by spaces in log order.

    The joined text itself is never built: text between the last separator of one description
    and the first of the next is put together from its neighbours.  Descriptions without any
    separator ("bridges") lie inside such a gap.
    """
    low = F.lower("descr")
    rows = carry.log_chunks(access, chunk_lines or carry.CHUNK_LINES).select(
        "test_id", "line_id", "pos", carry.CHUNK, low.alias("d"),
        F.when(low.rlike(r"[\[\].]"), 1).otherwise(0).alias("sep"))
    ran = carry.with_running(rows, ["test_id"], carry.LOG_ORDER, "sep", "gap")
    bridges = (ran.where("sep = 0").groupBy("test_id", "gap").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_id", "pos", "d"))), lambda e: e["d"]), " ").alias("_bridge"),
        F.min(F.struct("line_id", "pos")).alias("_at")))
    parted = ran.where("sep = 1").withColumns({
        "head": F.regexp_extract("d", r"^[^\[\].]*", 0), "tail": F.regexp_extract("d", r"[^\[\].]*$", 0)})
    parted = parted.withColumn("inner", F.expr("substring(d, length(head) + 1, length(d) - length(head) - length(tail))"))
    held = carry.with_previous(parted, ["test_id"], carry.LOG_ORDER, ["tail"])
    last = parted.groupBy("test_id").agg(F.max("gap").alias("_last"))
    held = carry.attach(held, last, ["test_id"])
    texts = bridges.select("test_id", "gap", "_bridge")
    before = texts.select("test_id", (F.col("gap") + 1).alias("gap"), F.col("_bridge").alias("_before"))
    after = texts.select("test_id", "gap", F.col("_bridge").alias("_after"))
    held = held.join(before, ["test_id", "gap"], "left").join(after, ["test_id", "gap"], "left")
    lead_in = F.concat(
        F.coalesce("prev.tail", F.lit("")),
        F.when(F.col("_before").isNotNull(),
               F.concat(F.when(F.col("prev").isNotNull(), " ").otherwise(""), F.col("_before"))).otherwise(""),
        F.when(F.col("prev").isNotNull() | F.col("_before").isNotNull(), " ").otherwise(""), "head")
    closing = F.when(F.col("gap") == F.col("_last"), F.concat(
        "tail", F.coalesce(F.concat(F.lit(" "), "_after"), F.lit("")))).otherwise("")
    pieces = F.filter(F.concat(F.array(lead_in), F.regexp_extract_all("inner", F.lit("(?U)" + PIECE), F.lit(0)),
                               F.array(closing)), lambda p: p != "")
    out = held.select("test_id", "line_id", "pos", carry.CHUNK, F.posexplode(pieces).alias("k", "piece"))
    # Runs without any separator are one piece.
    whole = (bridges.where("gap = 0").join(last, "test_id", "left_anti")
             .select("test_id", "_at.line_id", "_at.pos", F.lit(0).cast("bigint").alias(carry.CHUNK),
                     F.lit(0).alias("k"), F.col("_bridge").alias("piece")))
    return out.unionByName(whole)


def piece_grams(access: DataFrame, chunk_lines=None) -> DataFrame:
    """(test_id, term, tf): 1- to 3-grams of the pieces, stop words left out first."""
    stop = stop_words(access.sparkSession)
    kept = materialize(path_pieces(access, chunk_lines).where(~F.col("piece").isin(stop)), "pieces")
    ahead = carry.with_next_two(kept, ["test_id"], ["line_id", "pos", "k"], ["piece"])
    two = F.concat_ws(" ", "piece", "next1.piece")
    three = F.concat_ws(" ", "piece", "next1.piece", "next2.piece")
    grams = F.array(F.col("piece"), F.when(F.col("next1").isNotNull(), two),
                    F.when(F.col("next2").isNotNull(), three))
    return (ahead.select("test_id", F.explode(grams).alias("term")).where("term is not null")
            .groupBy("test_id", "term").agg(F.count("*").alias("tf")))


def run_tfidf(access: DataFrame, chunk_lines=None, cap: int = CORPUS_VOCABULARY) -> DataFrame:
    """TF-IDF of runs over path pieces: (test_id, term, weight)."""
    counted = materialize(piece_grams(access, chunk_lines), "piece-grams")
    vocab = (counted.groupBy("term").agg(F.sum("tf").alias("n"))
             .orderBy(F.desc("n"), F.asc("term")).limit(cap).select("term"))
    return corpus_weights(counted.join(F.broadcast(vocab), "term"), access.select("test_id").distinct(), "test_id")


def dense_vectors(weights: DataFrame, docs: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Weights as arrays over the alphabetical vocabulary, and that vocabulary (at most the cap)."""
    vocab = weights.select("term").distinct()
    terms = vocab.agg(F.array_sort(F.collect_list("term")).alias("terms"))  # capped by the vocabulary
    listed = [r.terms for r in terms.collect()][0]
    index = weights.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(listed)], "term string, idx int")
    maps = (weights.join(F.broadcast(index), "term").groupBy(doc)
            .agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("_m")))
    slots = F.sequence(F.lit(0), F.lit(len(listed) - 1)) if listed else F.array().cast("array<int>")
    dense = F.transform(slots, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return docs.join(maps, doc, "left").select(doc, dense.alias("vector")), index


class PcaFit:
    """Centring and projection fitted by Spark ML; component signs make the largest loading positive."""

    def __init__(self, scaler, pca):
        self.scaler, self.pca = scaler, pca
        loadings = pca.pc.toArray()
        self.signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])

    def transform(self, df: DataFrame, out="embedding") -> DataFrame:
        scored = self.pca.transform(self.scaler.transform(df))
        signs = F.array(*[F.lit(float(s)) for s in self.signs])
        return scored.withColumn(out, F.zip_with(vector_to_array("_pc"), signs, lambda a, s: a * s)).drop(
            "_v", "_centred", "_pc")


def pca_fit(df: DataFrame, k: int) -> PcaFit:
    scaler = StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False).fit(df)
    return PcaFit(scaler, PCA(k=k, inputCol="_centred", outputCol="_pc").fit(scaler.transform(df)))


def project(df: DataFrame, vector: str, k: int = PCA_DIMS, out="embedding") -> tuple[DataFrame, PcaFit | None]:
    """Project an ARRAY<DOUBLE> column to ``k`` centred principal components.

    ``k`` shrinks to the number of rows or dimensions; a single row projects to zeros.
    """
    shape = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    k = min(k, shape.n, shape.d or 0)
    if shape.n < 2 or k < 1:
        return df.withColumn(out, F.array_repeat(F.lit(0.0), k)), None
    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    fit = pca_fit(ready, k)
    return fit.transform(ready, out), fit


def run_embeddings(access: DataFrame, chunk_lines=None) -> tuple[DataFrame, PcaFit | None, DataFrame]:
    """(test_id, embedding, embedding_size), the fitted projection and the vocabulary.

    Ten components when there are more than ten terms, the raw weights otherwise.
    """
    runs = access.select("test_id").distinct()
    weights = materialize(run_tfidf(access, chunk_lines), "run-tfidf")
    vectors, vocab = dense_vectors(weights, runs, "test_id")
    vectors = materialize(vectors, "run-vectors")
    fit = None
    if vocab.count() > PCA_DIMS:
        out, fit = project(vectors, "vector")
    else:
        out = vectors.withColumn("embedding", F.col("vector"))
    return out.select("test_id", "embedding", F.size("embedding").alias("embedding_size")), fit, vocab
