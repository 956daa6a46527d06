"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelathe.operators import (access_patterns as ap, activity, carry, cluster, embed, errors, evidence,
                                  forest, fsm as machines, parse, registers, sequences, spanning, text, triage)
from tracelathe.plans import views
from tracelathe.plans.features import assemble, extract_features
from tracelathe.session import materialize, spread
from tracelathe.sources.regression import status_counts

# Standardised access vectors of a few dozen events per user are sparse; a wider radius than the
# default gives clusters to compare.
QUERY_EPS = 1.5

_CASTS = {"s": "string", "i": "bigint", "b": "boolean"}


def shape(df: DataFrame, columns: str) -> DataFrame:
    """Select and type result columns: s text, i whole number, b flag, fN double rounded to N."""
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        c = F.col(name)
        out.append((F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)).alias(name) if kind[0] == "f"
                   else c.cast(_CASTS[kind]).alias(name))
    return df.select(*out)


@dataclass(frozen=True)
class Query:
    columns: str
    build: Callable[[SparkSession, str], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(spark, sf_dir), self.columns)


QUERIES: dict[str, Query] = {}


def query(columns: str):
    def register(build):
        QUERIES[build.__name__] = Query(columns, build)
        return build
    return register


def _access(spark, sf):
    return views.tables(spark, sf)["access"]


def _steps_lines(spark, sf):
    return views.tables(spark, sf)["lines"]


# --- parsing ---------------------------------------------------------------------------------

@query("test_id:s line_id:i pos:i ts_ns:i action:s address:s size:s descr:s value:i comment:s")
def parse_access(spark, sf):
    return parse.parse_access(views.lines(spark, sf))


@query("test_id:s line_id:i pos:i ts_ns:i action:s address:s descr:s value:i comment:s")
def parse_spanning(spark, sf):
    """Access records broken over lines."""
    return parse.parse_access(spanning.joined(materialize(views.broken_lines(spark, sf), "broken-lines")))


@query("test_id:s line_id:i name:s what:s ts_ns:i")
def parse_spanning_marks(spark, sf):
    """Transitions and errors broken over lines, with the time of the access record before them."""
    lines = materialize(spanning.joined(materialize(views.broken_lines(spark, sf), "broken-lines")), "joined-lines")
    marks = materialize(parse.stamped(parse.found(lines, "record")), "marks")  # one scan for both
    fsm, err = parse.transitions(marks), parse.messages(marks)
    return (fsm.select("test_id", "line_id", F.col("fsm_name").alias("name"), F.concat("from_state", F.lit("->"), "to_state").alias("what"), "ts_ns")
            .unionByName(err.select("test_id", "line_id", F.lit("error").alias("name"), F.col("message").alias("what"), "ts_ns")))


@query("test_id:s line_id:i pos:i ts_ns:i fsm_name:s from_state:s to_state:s kind:s")
def parse_fsm(spark, sf):
    return parse.parse_fsm(_steps_lines(spark, sf))


@query("test_id:s line_id:i pos:i ts_ns:i message:s")
def parse_errors(spark, sf):
    return parse.parse_errors(_steps_lines(spark, sf))


@query("test_id:s line_id:i kind:s ts_ns:i")
def asof_timestamp(spark, sf):
    lines = _steps_lines(spark, sf)
    return (parse.parse_fsm(lines, ts_source="record").select("test_id", "line_id", F.lit("fsm").alias("kind"), "ts_ns")
            .unionByName(parse.parse_errors(lines, "record").select(
                "test_id", "line_id", F.lit("error").alias("kind"), "ts_ns")))


@query("test_id:s status:s")
def run_status(spark, sf):
    return views.runs(spark, sf)


@query("status:s n:i")
def run_status_counts(spark, sf):
    return status_counts(views.runs(spark, sf))


@query("test_id:s line_id:i part:i ts_text:s action:s descr:s value_hex:s")
def analysis_union(spark, sf):
    return views.frame(spark, sf)


@query("test_id:s line_id:i is_read:b is_write:b is_array:b is_fsm_related:b is_status:b")
def access_flags(spark, sf):
    return _access(spark, sf)


@query("test_id:s array_name:s example:s importance:f3 reason:s")
def register_arrays(spark, sf):
    return evidence.register_arrays(views.frame(spark, sf))


@query("test_id:s line_id:i value_hex:s value:i value_d:f3 value_bits:i")
def hex_values(spark, sf):
    return _access(spark, sf)


@query("test_id:s line_id:i part:i relative_time:f6")
def relative_time(spark, sf):
    return registers.relative_seconds(views.frame(spark, sf))


# --- register values -------------------------------------------------------------------------

@query("test_id:s descr:s n:i min:i max:i mean:f3 median:f3 std:f3 n_unique:i range:i importance:f3")
def register_value_stats(spark, sf):
    return registers.register_values(_access(spark, sf))


@query("test_id:s descr:s mean_diff:f3 max_diff:f3 diff_std:f3 change_frequency:f6")
def register_diff_stats(spark, sf):
    return registers.register_values(_access(spark, sf))


@query("test_id:s descr:s n_transitions:i")
def value_transitions(spark, sf):
    return registers.value_transitions(registers.value_steps(_access(spark, sf)))


@query("test_id:s descr:s bits_ever:i bits_always:i bits_toggled:i mean_popcount:f6 mean_hamming:f6")
def bit_stats(spark, sf):
    return registers.register_values(_access(spark, sf))


# --- sequences -------------------------------------------------------------------------------

def _windows(spark, sf):
    return sequences.sequence_windows(_access(spark, sf))


@query("test_id:s line_id:i registers:s actions:s values:s start_ns:i end_ns:i duration_ns:i")
def sequence_windows(spark, sf):
    w = _windows(spark, sf).withColumn("line_id", F.col("start_pos.line_id"))
    return w.withColumns({c: F.array_join(c, ",") for c in ("registers", "actions", "values")})


@query("test_id:s sequence:s n:i rank:i")
def sequence_top10(spark, sf):
    return sequences.top_sequences(sequences.sequence_counts(_windows(spark, sf)))


@query("test_id:s total:i n_unique:i entropy:f6 top_size:i ai_size:i first_top:s first_ai:s")
def sequence_summary(spark, sf):
    ai = sequences.ai_sequences(views.frame(spark, sf))
    out = sequences.sequence_summary(sequences.sequence_counts(_windows(spark, sf)), ai)
    return out.select("*", F.size("top").alias("top_size"), F.size("ai_top").alias("ai_size"),
                      F.col("top")[0]["sequence"].alias("first_top"), F.col("ai_top")[0]["sequence"].alias("first_ai"))


@query("test_id:s sequence:s n:i rank:i")
def text_order_sequences(spark, sf):
    return sequences.ai_sequences(views.frame(spark, sf))


# --- state machines --------------------------------------------------------------------------

def _edges(spark, sf):
    return machines.transitions(views.tables(spark, sf)["fsm"])


@query("test_id:s fsm_name:s total:i n_transitions:i n_states:i start_state:s end_state:s entropy:f6"
       " n_self_loops:i n_two_cycles:i n_cycles:i has_cycles:b")
def fsm_summary(spark, sf):
    return machines.fsm_summary(_edges(spark, sf))


@query("test_id:s fsm_name:s edge:s n:i")
def fsm_transitions(spark, sf):
    return _edges(spark, sf).withColumn("edge", F.concat("from_state", F.lit("->"), "to_state"))


@query("test_id:s fsm_name:s state:s visits:i")
def fsm_state_visits(spark, sf):
    return machines.state_visits(_edges(spark, sf))


@query("test_id:s fsm_name:s from_state:s to_state:s n:i")
def fsm_matrix(spark, sf):
    return machines.transition_matrix(_edges(spark, sf), dense=True)


@query("test_id:s fsm_name:s length:i cycle:s")
def fsm_cycles(spark, sf):
    return machines.cycles(_edges(spark, sf))


# --- access patterns -------------------------------------------------------------------------

@query("test_id:s descr:s reads:i writes:i rw_ratio:f6")
def rw_ratio(spark, sf):
    return ap.rw_ratio(_access(spark, sf))


@query("test_id:s descr:s read_mean_interval:f3 read_std_interval:f3 write_mean_interval:f3"
       " write_std_interval:f3 mean_interval:f3 std_interval:f3 max_interval:f3 access_frequency:f9")
def interval_stats(spark, sf):
    return ap.interval_stats(_access(spark, sf))


@query("test_id:s descr:s start_ns:i end_ns:i length:i")
def bursts(spark, sf):
    return ap.bursts(_access(spark, sf), views.BURST_GAP_NS)


@query("test_id:s descr:s n_bursts:i mean_len:f6 max_len:i total_accesses:i")
def burst_stats(spark, sf):
    return ap.burst_stats(ap.bursts(_access(spark, sf), views.BURST_GAP_NS))


# --- whole-run activity ----------------------------------------------------------------------

@query("test_id:s duration_s:f3 total:i rate:f9 reads:i writes:i rw_ratio:f6 peak_bin:i n_phases:i periodic:b")
def run_activity(spark, sf):
    return activity.run_activity(_access(spark, sf))


@query("test_id:s bin:i reads:i writes:i")
def activity_bins(spark, sf):
    return activity.dense_bins(activity.bin_arrays(_access(spark, sf)))


@query("test_id:s peak_bin:i")
def peak_bin(spark, sf):
    return activity.peak_bin(activity.bin_arrays(_access(spark, sf)))


@query("test_id:s phase:i label:s start_bin:i end_bin:i mean_reads:f6 mean_writes:f6")
def activity_phases(spark, sf):
    return activity.activity_phases(activity.bin_arrays(_access(spark, sf)))


@query("test_id:s lag:i read_r:f6 write_r:f6 periodic:b")
def autocorrelation(spark, sf):
    acf = activity.periodicity(activity.bin_arrays(_access(spark, sf)))
    return acf.select("test_id", "periodic", F.posexplode(F.arrays_zip("read_acf", "write_acf")).alias("lag", "_z")
                      ).select("test_id", "periodic", "lag", F.col("_z.read_acf").alias("read_r"),
                               F.col("_z.write_acf").alias("write_r"))


# --- errors ----------------------------------------------------------------------------------

@query("test_id:s line_id:i ts_ns:i message:s context_size:i")
def error_context(spark, sf):
    t = views.tables(spark, sf)
    return errors.error_context(t["access"], t["err"], views.CONTEXT_NS)


@query("test_id:s err_ns:i line_id:i ts_ns:i action:s descr:s value_hex:s")
def error_context_rows(spark, sf):
    t = views.tables(spark, sf)
    return errors.context_rows(t["access"], t["err"], views.CONTEXT_NS)


@query("test_id:s error_count:i first_ns:i last_ns:i avg_context_size:f6")
def error_summary(spark, sf):
    t = views.tables(spark, sf)
    return errors.error_summary(t["runs"], t["access"], t["err"], views.CONTEXT_NS)


@query("test_id:s ts_ns:i line_id:i message:s")
def error_messages(spark, sf):
    return errors.error_messages(views.tables(spark, sf)["err"])


@query("test_id:s term:s n:i rank:i")
def error_terms(spark, sf):
    return errors.error_terms(views.tables(spark, sf)["err"])


# --- text ------------------------------------------------------------------------------------

@query("test_id:s term:s score:f6 rank:i")
def tfidf_terms(spark, sf):
    return text.term_scores(text.described(views.frame(spark, sf)))


@query("test_id:s descr:s term:s score:f6 address:s")
def important_registers(spark, sf):
    """All registers that hold an important term; the first 50 count only where evidence is merged."""
    return text.top_registers(views.frame(spark, sf), None)


@query("doc_id:i term:s weight:f6")
def doc_tfidf(spark, sf):
    return text.document_tfidf(spread(views.table(spark, sf, "documents")), "doc_id", "text")


@query("test_id:s piece:s n:i")
def path_pieces(spark, sf):
    return embed.path_pieces(_access(spark, sf)).groupBy("test_id", "piece").agg(F.count("*").alias("n"))


@query("test_id:s term:s weight:f6")
def test_embedding(spark, sf):
    return embed.run_tfidf(_access(spark, sf))


@query("test_id:s embedding_size:i dim:i component:f6")
def run_embedding(spark, sf):
    out, _, _ = embed.run_embeddings(_access(spark, sf))
    return out.select("test_id", "embedding_size", F.posexplode("embedding").alias("dim", "component"))


@query("vec_id:i dim:i component:f6")
def embedding_pca(spark, sf):
    out, _ = embed.project(views.table(spark, sf, "embeddings").select("vec_id", "embedding"),
                           "embedding", out="projected")
    return out.select("vec_id", F.posexplode("projected").alias("dim", "component"))


# --- vectors, clusters, forests --------------------------------------------------------------

@query("test_id:s descr:s reads:i writes:i n_values:i mean_value:f3 std_value:f3 read_gap:f3 write_gap:f3")
def access_vectors(spark, sf):
    return registers.access_vectors(_access(spark, sf))


@query("test_id:s descr:s reads:f6 writes:f6 n_values:f6 mean_value:f6 std_value:f6 read_gap:f6 write_gap:f6")
def scaled_vectors(spark, sf):
    return registers.standardise(registers.access_vectors(_access(spark, sf)), registers.ACCESS_DIMS)


def _clusters(spark, sf, eps=QUERY_EPS):
    scaled = registers.standardise(registers.access_vectors(_access(spark, sf)), registers.ACCESS_DIMS)
    return cluster.density_clusters(scaled, registers.ACCESS_DIMS, grid=evidence.ACCESS_GRID, eps=eps)


@query("test_id:s descr:s cluster_id:i")
def access_clusters(spark, sf):
    return _clusters(spark, sf)


@query("test_id:s descr:s cluster_id:i")
def corpus_clusters(spark, sf):
    """Registers of all runs that behave alike, at the operator's own radius."""
    return evidence.corpus_clusters(_access(spark, sf)).select("test_id", "descr", "cluster_id")


@query("test_id:s descr:s mean:f3 std:f3 min:f3 max:f3 range:f3 entropy:f6 n:i")
def value_vectors(spark, sf):
    return registers.value_vectors(_access(spark, sf))


@query("test_id:s descr:s entropy:f6")
def value_entropy(spark, sf):
    return registers.value_vectors(_access(spark, sf))


@query("test_id:s descr:s anomaly_type:s confidence:f6")
def forest_flags(spark, sf):
    return evidence.register_anomalies(_access(spark, sf))


def _corpus_flags(spark, rows, ids, dims, label):
    rows = materialize(rows.select(F.lit("all").alias("corpus"), *ids, *dims), f"{label}-rows")  # for the moments and their join
    scaled = materialize(registers.standardise(rows, dims, ["corpus"], ids), f"{label}-vectors")
    return forest.flag_anomalies(scaled, ["corpus"], ids, dims, label)


@query("test_id:s descr:s anomaly_type:s confidence:f6")
def value_forest(spark, sf):
    stats = registers.register_values(_access(spark, sf))
    return _corpus_flags(spark, stats, ["test_id", "descr"],
                         ["n", "mean", "std", "n_unique", "mean_diff", "diff_std", "change_frequency"], "value")


@query("test_id:s anomaly_type:s confidence:f6")
def temporal_forest(spark, sf):
    totals = activity.run_totals(_access(spark, sf)).withColumn(
        "rw_ratio", F.when(F.col("writes") > 0, F.col("rw_ratio")).otherwise(F.col("reads")))
    return _corpus_flags(spark, totals, ["test_id"], ["duration_s", "total", "rate", "reads", "writes", "rw_ratio"],
                         "temporal")


@query("test_id:s descr:s importance:f6 source:s reason:s")
def register_importance(spark, sf):
    return _importance(spark, sf)


def _importance(spark, sf):
    frame = views.frame(spark, sf)
    return evidence.register_importance(text.top_registers(frame), _clusters(spark, sf),
                                        sequences.ai_sequences(frame))


@query("descr:s importance:f6")
def corpus_importance(spark, sf):
    return evidence.corpus_importance(_importance(spark, sf))


@query("test_id:s line_id:i descr:s ai_importance:f6")
def importance_tags(spark, sf):
    return evidence.tag_importance(_access(spark, sf), _importance(spark, sf))


# --- assembly and triage ---------------------------------------------------------------------

def _features(spark, sf):
    t = views.tables(spark, sf)
    families = ["register_values", "register_sequences", "fsm_transitions", "register_access_patterns",
                "temporal_patterns", "error_contexts"]
    return assemble(t["runs"], extract_features(t, families, burst_gap_ns=views.BURST_GAP_NS,
                                                context_ns=views.CONTEXT_NS))


@query("test_id:s status:s family:s entity:s feature:s value:f3")
def run_features(spark, sf):
    return _features(spark, sf)


@query("test_id:s status:s family:s entity:s feature:s value:f3")
def run_features_all(spark, sf):
    """The same with the seventh family, whose projection SQL can't express."""
    t = views.tables(spark, sf)
    return assemble(t["runs"], extract_features(t, burst_gap_ns=views.BURST_GAP_NS, context_ns=views.CONTEXT_NS))


def _triage(spark, sf):
    features = materialize(_features(spark, sf), "run-features")
    baseline = materialize(triage.learn_baseline(features), "baseline")
    return baseline, triage.deviations(features, baseline)


@query("family:s entity:s feature:s mean:f3 std:f3 support:i p05:f3 p95:f3")
def baseline(spark, sf):
    return _triage(spark, sf)[0]


@query("test_id:s family:s entity:s feature:s value:f3 p05:f3 p95:f3 outside:b")
def deviations(spark, sf):
    return _triage(spark, sf)[1]


@query("test_id:s fsm_name:s from_state:s to_state:s")
def unseen_edges(spark, sf):
    return triage.unseen(_edges(spark, sf), views.tables(spark, sf)["runs"], ["fsm_name", "from_state", "to_state"])


@query("test_id:s sequence:s")
def unseen_sequences(spark, sf):
    counts = sequences.sequence_counts(_windows(spark, sf))
    return triage.unseen(counts, views.tables(spark, sf)["runs"], ["sequence"])


@query("test_id:s descr:s")
def unseen_registers(spark, sf):
    return triage.unseen(_access(spark, sf), views.tables(spark, sf)["runs"], ["descr"])


def _buckets(spark, sf):
    t = views.tables(spark, sf)
    deviating = materialize(_triage(spark, sf)[1], "deviations")
    signed = triage.signatures(t["runs"], t["err"], deviating)
    return triage.failure_buckets(signed), signed, deviating


@query("bucket_id:s message:s register:s size:i representative:s max_z:f3")
def failure_buckets(spark, sf):
    return _buckets(spark, sf)[0]


@query("bucket_id:s size:i test_id:s rank:i family:s entity:s feature:s value:f3 z:f3")
def triage_report(spark, sf):
    return triage.triage_report(*_buckets(spark, sf))


@query("descr:s feature:s failing_value:f3 baseline_mean:f3 z:f3 test_id:s rank:i")
def erratic_registers(spark, sf):
    """Which registers of failing runs change value most erratically, against passing runs?"""
    t = views.tables(spark, sf)
    features = materialize(assemble(t["runs"], extract_features(t, ["register_values"])), "value-features")
    wanted = ["std", "diff_std", "mean_diff", "change_frequency"]
    found = triage.deviations(features.where(F.col("feature").isin(wanted)),
                              triage.learn_baseline(features.where(F.col("feature").isin(wanted))))
    ranked = carry.at_most(found.where("z is not null"), ["feature"],
                           [F.desc(F.round(F.abs("z"), 6)), F.asc("test_id"), F.asc("entity")], 20)
    return ranked.select(F.col("entity").alias("descr"), "feature", F.col("value").alias("failing_value"),
                         F.col("mean").alias("baseline_mean"), "z", "test_id", "rank")
