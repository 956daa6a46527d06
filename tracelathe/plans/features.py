"""Feature families by name, and the table that joins them per run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tracelathe.operators import (access_patterns as ap, activity, carry, errors, fsm as machines,
                                  registers, sequences)
from tracelathe.operators.embed import run_embeddings
from tracelathe.schema import BURST_GAP_NS, CONTEXT_NS

FAMILIES = ["register_values", "register_sequences", "fsm_transitions", "register_access_patterns",
            "temporal_patterns", "error_contexts", "token_embeddings"]


def extract_features(tables: dict[str, DataFrame], families: list[str] | None = None, *,
                     importance: DataFrame | None = None, ai_sequences: DataFrame | None = None,
                     burst_gap_ns=BURST_GAP_NS, context_ns=CONTEXT_NS) -> dict[str, DataFrame]:
    """Requested families (all seven by default) as tables; the others are not planned at all.

    ``tables`` holds runs, access, fsm and err.
    """
    runs, access, fsm, err = (tables[k] for k in ("runs", "access", "fsm", "err"))
    build = {
        "register_values": lambda: {"register_values": registers.register_values(access, importance)},
        "register_sequences": lambda: {"register_sequences": sequences.sequence_summary(
            sequences.sequence_counts(sequences.sequence_windows(access)), ai_sequences)},
        "fsm_transitions": lambda: {"fsm_transitions": machines.fsm_summary(machines.transitions(fsm))},
        "register_access_patterns": lambda: {
            "register_access_patterns": ap.access_patterns(access),
            "burst_stats": ap.burst_stats(ap.bursts(access, burst_gap_ns))},
        "temporal_patterns": lambda: {"temporal_patterns": activity.run_activity(access)},
        "error_contexts": lambda: {"error_contexts": errors.error_summary(runs, access, err, context_ns)},
        "token_embeddings": lambda: {"token_embeddings": run_embeddings(access)[0]},
    }
    wanted = FAMILIES if families is None else families
    unknown = set(wanted) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown feature families: {sorted(unknown)}")
    return {k: v for f in FAMILIES if f in wanted for k, v in build[f]().items()}


# Scalar features of each table: (family, entity column, columns).
_LONG = {
    "register_values": ("register_values", "descr", [
        "n", "min", "max", "mean", "median", "std", "n_unique", "range", "mean_popcount", "mean_hamming",
        "mean_diff", "max_diff", "diff_std", "n_transitions", "change_frequency", "importance"]),
    "register_sequences": ("register_sequences", None, ["total", "n_unique", "entropy"]),
    "fsm_transitions": ("fsm_transitions", "fsm_name", [
        "total", "n_transitions", "n_states", "entropy", "n_self_loops", "n_two_cycles", "n_cycles"]),
    "register_access_patterns": ("register_access_patterns", "descr", [
        "reads", "writes", "rw_ratio", "read_mean_interval", "read_std_interval", "write_mean_interval",
        "write_std_interval", "mean_interval", "std_interval", "max_interval", "access_frequency"]),
    "burst_stats": ("register_access_patterns", "descr", ["n_bursts", "mean_len", "max_len", "total_accesses"]),
    "temporal_patterns": ("temporal_patterns", None, [
        "duration_s", "total", "rate", "reads", "writes", "rw_ratio", "peak_bin", "n_phases", "periodic"]),
    "error_contexts": ("error_contexts", None, ["error_count", "first_s", "last_s", "avg_context_size"]),
}


def melt(name: str, table: DataFrame, *more: str) -> DataFrame:
    """A family table in long form: (test_id, family, entity, feature, value), with further columns kept."""
    if name == "token_embeddings":
        return table.select("test_id", F.lit(name).alias("family"), F.lit("").alias("entity"),
                            *more, F.posexplode("embedding").alias("_i", "value")).select(
            "test_id", "family", "entity", F.format_string("dim_%02d", "_i").alias("feature"), "value", *more)
    if name == "error_contexts":  # whole nanoseconds of the epoch do not fit a double
        table = table.withColumns({"first_s": F.col("first_ns") / 1e9, "last_s": F.col("last_ns") / 1e9})
    family, entity, columns = _LONG[name]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in columns])).alias("_p")
    return (table.select("test_id", F.lit(family).alias("family"),
                         (F.col(entity) if entity else F.lit("")).alias("entity"), *more, pairs)
            .select("test_id", "family", "entity", "_p.feature", "_p.value", *more).where("value is not null"))


def assemble(runs: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """All families per run with its status.  Long rows instead of one nested row: a run may hold
    any number of registers.  A run without a family has no rows of it."""
    status = runs.select("test_id", F.coalesce("status", F.lit("unknown")).alias("status"))
    # The status is joined to the wide rows: long ones are many times as many.
    few = carry.few_rows(status)
    by_run = lambda n, t: carry.with_facts(t, status, ["test_id"], [_LONG[n][1]] if n in _LONG and _LONG[n][1] else [], few)
    return reduce(DataFrame.unionByName, [melt(n, by_run(n, t), "status") for n, t in features.items()])
