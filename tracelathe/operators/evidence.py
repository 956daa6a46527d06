"""Per-run register intelligence put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelathe.operators import carry
from tracelathe.operators.cluster import density_clusters
from tracelathe.operators.forest import flag_anomalies
from tracelathe.operators.parse import array_name
from tracelathe.operators.registers import (ACCESS_DIMS, VALUE_DIMS, access_vectors, standardise,
                                            value_vectors)
from tracelathe.operators.sequences import ai_sequences
from tracelathe.operators.text import top_registers
from tracelathe.schema import (ARRAY_IMPORTANCE, ARRAY_REASON, CLUSTER_IMPORTANCE, CLUSTER_MEMBERS, CLUSTER_REASON,
                               SEQUENCE_REASON, TERM_REASON)
from tracelathe.session import materialize

# Dimensions of the access vector the neighbour grid uses: all but the number of values, which follows from reads and writes.
ACCESS_GRID = [0, 1, 3, 4, 5, 6]


def access_clusters(access: DataFrame) -> DataFrame:
    """Registers with similar access vectors: (test_id, descr, first_at, cluster_id), no noise.
    Members stay rows; a cluster may hold any number of them."""
    return density_clusters(standardise(access_vectors(access), ACCESS_DIMS), ACCESS_DIMS, grid=ACCESS_GRID)


def corpus_clusters(access: DataFrame) -> DataFrame:
    """Registers of all runs with similar access vectors: (test_id, descr, first_at, cluster_id), no noise.

    The runs are one group here: vectors are scaled over all of them.  Registers of several runs may first appear
    at the same place, so they are told apart, and clusters numbered, by place and then by run and name.
    """
    vectors = access_vectors(access).withColumns({
        "corpus": F.lit(True), "register": F.struct("test_id", "descr"), "at": F.struct("first_at", "test_id", "descr")})
    scaled = standardise(vectors, ACCESS_DIMS, ["corpus"], ["test_id", "descr"])
    found = density_clusters(scaled, ACCESS_DIMS, ["corpus"], "at", "register", grid=ACCESS_GRID)
    return found.select("register.*", F.col("at.first_at").alias("first_at"), "cluster_id")


def register_anomalies(access: DataFrame) -> DataFrame:
    scaled = materialize(standardise(value_vectors(access), VALUE_DIMS), "value-vectors")
    return flag_anomalies(scaled, ["test_id"], ["descr"], VALUE_DIMS)


def register_arrays(frame: DataFrame) -> DataFrame:
    """Distinct array names with the first description that showed them."""
    named = frame.withColumn("array_name", array_name(F.col("descr"))).where("array_name <> ''")
    return (named.groupBy("test_id", "array_name")
            .agg(F.min_by("descr", F.struct("part", "line_id", "pos")).alias("example"))
            .withColumn("importance", F.lit(ARRAY_IMPORTANCE))
            .withColumn("reason", F.lit(ARRAY_REASON)))


def register_importance(top: DataFrame, clusters: DataFrame, sequences: DataFrame) -> DataFrame:
    """Evidence merged per register; the first source wins: terms, then clusters, then sequences."""
    by_term = top.select(
        "test_id", "descr", F.lit(1).alias("src"), F.col("rank").cast("long").alias("a"), F.lit(0).alias("b"),
        F.col("score").alias("importance"), F.lit("terms").alias("source"),
        F.format_string(TERM_REASON, "score", "term").alias("reason"))
    members = carry.at_most(clusters, ["test_id", "cluster_id"], [F.asc("first_at")], CLUSTER_MEMBERS, "member_no")
    by_cluster = members.select(
        "test_id", "descr", F.lit(2).alias("src"), F.col("cluster_id").cast("long").alias("a"),
        F.col("member_no").alias("b"), F.lit(CLUSTER_IMPORTANCE).alias("importance"),
        F.lit("cluster").alias("source"),
        F.format_string(CLUSTER_REASON, "cluster_id").alias("reason"))
    by_sequence = sequences.select(
        "test_id", "n", F.col("rank").cast("long").alias("a"),
        F.posexplode(F.split("sequence", "->")).alias("b", "descr")).select(
        "test_id", "descr", F.lit(3).alias("src"), "a", "b", (F.col("n") / 10).alias("importance"),
        F.lit("sequence").alias("source"),
        F.format_string(SEQUENCE_REASON, "n").alias("reason"))
    merged = by_term.unionByName(by_cluster).unionByName(by_sequence)
    best = F.min_by(F.struct("importance", "source", "reason", "src", "a", "b"), F.struct("src", "a", "b"))
    return merged.groupBy("test_id", "descr").agg(best.alias("_e")).select(
        "test_id", "descr", "_e.importance", "_e.source", "_e.reason",
        F.struct("_e.src", "_e.a", "_e.b").alias("found_at"))


def corpus_importance(importance: DataFrame) -> DataFrame:
    """Highest importance of each register over all runs."""
    return importance.groupBy("descr").agg(F.max("importance").alias("importance"))


def tag_importance(access: DataFrame, importance: DataFrame) -> DataFrame:
    """Accesses with their register's importance in the run; null where it has none."""
    return carry.salted_join(access, importance.select("test_id", "descr", F.col("importance").alias("ai_importance")),
                             ["test_id", "descr"], ["line_id", "pos"], "left")


def extract_intelligence(access: DataFrame, frame: DataFrame) -> dict[str, DataFrame]:
    """All tables of the per-run intelligence step.  Runs without rows simply have none."""
    clusters = access_clusters(access)
    sequences = ai_sequences(frame)
    return {
        "register_importance": register_importance(top_registers(frame), clusters, sequences),
        "register_arrays": register_arrays(frame),
        "ai_sequences": sequences,
        "access_clusters": clusters,
        "register_anomalies": register_anomalies(access),
    }
