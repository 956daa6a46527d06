"""State-machine features from transition records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelathe.functions.exprs import count_entropy
from tracelathe.schema import MIN_TRANSITIONS
from tracelathe.session import materialize

FSM = ["test_id", "fsm_name"]
MAX_CYCLE = 5  # how long the listed cycles are at most; whether there are any doesn't depend on it
_AT = ["ts_ns", "kind_rank", "line_id", "pos"]


def transitions(fsm: DataFrame) -> DataFrame:
    """Counted edges of machines with >= 2 transitions, with their first and last time."""
    at = F.struct("ts_ns", F.when(F.col("kind") == "sleep", 0).otherwise(1).alias("kind_rank"),
                  "line_id", "pos")
    edges = fsm.groupBy(*FSM, "from_state", "to_state").agg(
        F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    enough = edges.groupBy(*FSM).agg(F.sum("n").alias("_n")).where(f"_n >= {MIN_TRANSITIONS}")
    return edges.join(enough.select(*FSM), FSM, "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*FSM).agg(
        F.min_by("from_state", "first_at").alias("start_state"),
        F.max_by("to_state", "last_at").alias("end_state"))


def state_visits(edges: DataFrame) -> DataFrame:
    """Every from-state, plus the state the machine ends in."""
    left = edges.groupBy(*FSM, F.col("from_state").alias("state")).agg(F.sum("n").alias("n"))
    last = _ends(edges).select(*FSM, F.col("end_state").alias("state"), F.lit(1).alias("n"))
    return left.unionByName(last).groupBy(*FSM, "state").agg(F.sum("n").alias("visits"))


def transition_matrix(edges: DataFrame, dense=False) -> DataFrame:
    """Counts per (from, to) over the union of from- and to-states.

    Long form lists the edges that occur; ``dense`` adds the zeros.  A dense matrix has
    states x states cells by definition; its rows are built from each machine's state set.
    """
    sparse = edges.select(*FSM, "from_state", "to_state", "n")
    if not dense:
        return sparse
    states = (sparse.select(*FSM, F.explode(F.array("from_state", "to_state")).alias("state"))
              .distinct())
    cells = (states.withColumnRenamed("state", "from_state")
             .join(states.withColumnRenamed("state", "to_state"), FSM))
    return (cells.join(sparse, [*FSM, "from_state", "to_state"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def cycles(edges: DataFrame, max_length: int = MAX_CYCLE) -> DataFrame:
    """Simple cycles up to ``max_length`` states, each once, starting at its smallest state.

    Their number may grow exponentially with the length, so the listing takes a bound;
    ``cyclic`` tells for any length whether a machine has cycles."""
    step = edges.select(*FSM, F.col("from_state").alias("_from"), F.col("to_state").alias("_to"))
    paths = step.where("_to >= _from").select(
        *FSM, F.col("_from").alias("start"), F.col("_to").alias("at"), F.array("_from").alias("states"))
    found = paths.where("at = start")
    for _ in range(max_length - 1):
        grown = (paths.where("at > start")
                 .join(step.withColumnRenamed("_from", "at"), [*FSM, "at"])
                 .where("_to >= start AND NOT array_contains(slice(states, 2, size(states)), _to) AND _to <> at")
                 .select(*FSM, "start", F.col("_to").alias("_next"),
                         F.array_append("states", F.col("at")).alias("states"))
                 .withColumnRenamed("_next", "at"))
        found = found.unionByName(grown.where("at = start"))
        paths = grown
    return found.select(*FSM, F.size("states").alias("length"), F.array_join("states", "->").alias("cycle"))


def _without_chains(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ways`` with every state of a single way out passed over, and the machines this shows to be cyclic.

    Such states point to the next one; pointers jump twice as far from round to round, so a chain of n
    states takes about log2(n) rounds.  A pointer that never leaves them goes round a cycle."""
    outs = ways.groupBy(*FSM, "from_state").agg(F.count("*").alias("_n"), F.min("to_state").alias("to_state"))
    jumps = materialize(outs.where("_n = 1").select(*FSM, "from_state", "to_state"), "jumps")
    domain = jumps.select(*FSM, "from_state")
    for _ in range(jumps.count().bit_length()):
        further = jumps.select(*FSM, F.col("from_state").alias("to_state"), F.col("to_state").alias("_further"))
        jumps = materialize(jumps.select(*FSM, "from_state", "to_state").join(further, [*FSM, "to_state"], "left")
                            .select(*FSM, "from_state", F.coalesce("_further", "to_state").alias("to_state"), F.col("_further").isNotNull().alias("_moved")), "jumps")
        if jumps.where("_moved").isEmpty():
            break
    ends = jumps.select(*FSM, F.col("from_state").alias("to_state"), F.col("to_state").alias("_end"))
    circling = jumps.join(domain.withColumnRenamed("from_state", "to_state"), [*FSM, "to_state"], "left_semi").select(*FSM)
    left = (ways.join(domain, [*FSM, "from_state"], "left_anti").join(ends, [*FSM, "to_state"], "left")
            .select(*FSM, "from_state", F.coalesce("_end", "to_state").alias("to_state")).distinct())
    left = materialize(left, "ways")
    loops = materialize(circling.union(left.where("from_state = to_state").select(*FSM)).distinct(), "looped")
    return left.join(loops, FSM, "left_anti"), loops


def cyclic(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Machines with a cycle of any length.  States without a way in or out are taken away until
    nothing changes: what is left holds cycles.  In between chains are passed over, so that they don't cost a
    round per state.  ``known`` machines need no look."""
    left = edges.select(*FSM, "from_state", "to_state").where("from_state <> to_state").distinct()
    if known is not None:
        left = left.join(known.select(*FSM), FSM, "left_anti")
    left = materialize(left, "ways")
    loops = edges.where("from_state = to_state").select(*FSM)
    size, rounds = left.count(), 0
    while size:
        entered = left.select(*FSM, F.col("to_state").alias("from_state")).distinct()
        exited = left.select(*FSM, F.col("from_state").alias("to_state")).distinct()
        left = materialize(left.join(entered, [*FSM, "from_state"], "left_semi")
                           .join(exited, [*FSM, "to_state"], "left_semi").select(*FSM, "from_state", "to_state"), "ways")
        before, size, rounds = size, left.count(), rounds + 1
        if size == before:
            break
        if size and rounds > 1:  # small machines are done by now
            left, found = _without_chains(left)
            left, loops = materialize(left, "ways"), loops.union(found)
            size = left.count()
    found = left.select(*FSM).union(loops)
    return (found if known is None else found.union(known.select(*FSM))).distinct()


def fsm_summary(edges: DataFrame, max_length: int = MAX_CYCLE) -> DataFrame:
    """One row per machine; states, edges and cycles as such are in their own tables.  ``n_cycles``
    counts those of up to ``max_length`` states, ``has_cycles`` knows them all."""
    edges = materialize(edges, "fsm-edges")
    totals = edges.groupBy(*FSM).agg(
        F.sum("n").alias("total"), F.count("*").alias("n_transitions"),
        count_entropy(F.col("n")).alias("entropy"),
        F.min_by("from_state", "first_at").alias("start_state"),
        F.max_by("to_state", "last_at").alias("end_state"))
    visited = state_visits(edges).groupBy(*FSM).agg(F.count("*").alias("n_states"))
    looped = materialize(cycles(edges, max_length).groupBy(*FSM).agg(
        F.count_if(F.col("length") == 1).alias("n_self_loops"),
        F.count_if(F.col("length") == 2).alias("n_two_cycles"),
        F.count("*").alias("n_cycles")), "fsm-cycles")
    some = cyclic(edges, looped).withColumn("_cyclic", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(visited, FSM).join(looped, FSM, "left").join(some, FSM, "left").select(
        *FSM, "total", "n_transitions", "n_states", "start_state", "end_state", "entropy",
        zero("n_self_loops"), zero("n_two_cycles"), zero("n_cycles"),
        F.coalesce("_cyclic", F.lit(False)).alias("has_cycles"))
