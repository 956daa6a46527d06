"""Sequences, machines, activity and errors."""

import math

import pytest

from tracelathe.operators import activity, errors, fsm as machines, parse, sequences


def test_sequences_sorted_by_time_ties_first(access_of):
    access = access_of([("t", ts, "R", d, v) for ts, d, v in [(3, "c", 3), (1, "a", 1), (2, "b", 2), (4, "a", 1), (5, "b", 2), (6, "c", 3)]])
    windows = sequences.sequence_windows(access)
    assert sorted((r.start_ns, r.registers, r.duration_ns) for r in windows.collect())[0] == (1, ["a", "b", "c"], 2)
    counts = sequences.sequence_counts(windows)
    top = sequences.top_sequences(counts).orderBy("rank").collect()
    assert [(r.sequence, r.n) for r in top] == [("a->b->c", 2), ("b->c->a", 1), ("c->a->b", 1)]
    s = sequences.sequence_summary(counts).collect()[0]
    assert (s.total, s.n_unique) == (4, 3) and s.entropy == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25)))


def test_text_order_against_numeric(access_of, lines_of):
    access = access_of([("t", 9, "R", "nine", 1), ("t", 10, "R", "ten", 1), ("t", 100, "R", "hundred", 1)])
    frame = parse.analysis_frame(access, parse.parse_fsm(lines_of("none")))
    assert [r.sequence for r in sequences.ai_sequences(frame).collect()] == ["ten->hundred->nine"]
    assert [r.sequence for r in sequences.ai_sequences(frame, order="numeric").collect()] == ["nine->ten->hundred"]


def test_machine_summary_and_visits(lines_of):
    lines = lines_of("[1] FSM m: A -> B", "[2] FSM m: C -> A", "[3] FSM one: A -> B")
    edges = machines.transitions(parse.parse_fsm(lines))
    assert {(r.state, r.visits) for r in machines.state_visits(edges).collect()} == {("A", 2), ("C", 1)}
    s = machines.fsm_summary(edges).collect()
    assert [(r.fsm_name, r.total, r.n_states, r.start_state, r.end_state, r.has_cycles) for r in s] == [
        ("m", 2, 2, "A", "A", False)]
    dense = {(r.from_state, r.to_state): r.n for r in machines.transition_matrix(edges, dense=True).collect()}
    assert len(dense) == 9 and dense[("A", "B")] == 1 and dense[("B", "C")] == 0


def test_cycles_of_any_length_are_known(lines_of):
    for n in (6, 40):
        ring = lines_of(*[f"FSM ring: S{k:02d} -> S{(k + 1) % n:02d}" for k in range(n)], *[f"FSM line: S{k:02d} -> S{k + 1:02d}" for k in range(n)])
        summary = machines.fsm_summary(machines.transitions(parse.parse_fsm(ring))).collect()
        assert {r.fsm_name: (r.n_cycles, r.has_cycles) for r in summary} == {"ring": (0, True), "line": (0, False)}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 states, the same closed to a ring, ladders, and rings behind chains."""
    tables = []
    plain = machines.materialize
    monkeypatch.setattr(machines, "materialize", lambda df, name: tables.append(name) or plain(df, name))
    n, rows = 10_000, []
    for name, last in (("chain", []), ("ring", [(n - 1, 0)])):
        rows += [("t", name, f"S{a}", f"S{b}") for a, b in [*[(k, k + 1) for k in range(n - 1)], *last]]
    rows += [("t", "ladder", f"S{k}", f"S{k + d}") for k in range(8) for d in (1, 2)]
    rows += [("t", "tailed", f"S{a}", f"S{b}") for a, b in [*[(k, k + 1) for k in range(300)], (300, 290)]]
    rows += [("t", "split", f"S{a}", f"S{b}") for a, b in [*[(k, k + 1) for k in range(90)], (10, 200), *[(k, k + 1) for k in range(200, 250)], (250, 90), (0, 90)]]
    edges = spark.createDataFrame(rows, "test_id string, fsm_name string, from_state string, to_state string")
    assert {r.fsm_name for r in machines.cyclic(edges).collect()} == {"ring", "tailed"}
    assert len(tables) < 50


def test_cycles_once_each(lines_of):
    lines = lines_of(*[f"[{i}] FSM m: {e}" for i, e in enumerate(["A -> A", "A -> B", "B -> A", "B -> C", "C -> A"])])
    found = machines.cycles(machines.transitions(parse.parse_fsm(lines))).collect()
    assert sorted((r.length, r.cycle) for r in found) == [(1, "A"), (2, "A->B"), (3, "A->B->C")]


def test_bins_exclude_left_edge(access_of):
    access = access_of([("t", ts, "R", "a", 1) for ts in (0, 5, 10, 20)])
    assert {(r.bin, r.reads) for r in activity.bin_counts(access, 4).collect()} == {(0, 1), (1, 1), (3, 1)}


def test_single_instant_run(access_of):
    access = access_of([("t", 7, "R", "a", 1)] * 3)
    r = activity.run_activity(access).collect()[0]
    assert (r.duration_s, r.rate, r.peak_bin, r.n_phases, r.periodic) == (0.0, 0.0, 0, 1, False)
    assert sum(r.reads_by_bin) == 0 and len(r.reads_by_bin) == 100 and r.read_acf == [0.0] * 11


def test_bin_totals_and_wide_spans(access_of):
    access = access_of([("t", i * i * 10**16, "R" if i % 2 else "W", "a", 1) for i in range(30)])
    bins = activity.bin_counts(access).collect()
    assert sum(b.reads + b.writes for b in bins) == 29 and max(b.bin for b in bins) == 99


def test_autocorrelation_matches_formula(spark):
    from pyspark.sql import functions as F
    xs = [float((i * 7) % 5) for i in range(30)]
    got = spark.createDataFrame([(xs,)], "x array<double>").select(activity.autocorrelation(F.col("x")).alias("r")).first().r
    m = sum(xs) / 30
    var = sum((x - m) ** 2 for x in xs)
    want = [sum((xs[t] - m) * (xs[t + k] - m) for t in range(30 - k)) / var for k in range(11)]
    assert got == pytest.approx(want)


def test_phases_cover_all_bins(access_of):
    access = access_of([("t", i, "R", "a", 1) for i in range(50)] + [("t", 1000, "R", "a", 1)])
    phases = activity.activity_phases(activity.bin_arrays(access)).orderBy("start_bin").collect()
    assert phases[0].start_bin == 0 and phases[-1].end_bin == 99
    assert all(a.end_bin + 1 == b.start_bin and a.label != b.label for a, b in zip(phases, phases[1:]))


def test_error_context_edges(spark, access_of, lines_of):
    access = access_of([("t", 5000 + d, "R", "a", 1) for d in (-1001, -1000, 0, 1)])
    err = parse.parse_errors(lines_of("[5000]", "ERROR: boom 0x1f at 12", "ERROR: boom", "[90]", "ERROR: early"))
    got = sorted((r.ts_ns, r.message, r.context_size) for r in errors.error_context(access, err).collect())
    assert got == [(90, "early", 0), (5000, "boom", 2), (5000, "boom 0x1f at 12", 2)]
    rows = errors.context_rows(access, err).collect()
    assert sorted((r.err_ns, r.ts_ns) for r in rows) == [(5000, 4000), (5000, 5000)]
    runs = spark.createDataFrame([("t",), ("quiet",)], "test_id string")
    s = {r.test_id: r for r in errors.error_summary(runs, access, err).collect()}
    assert (s["t"].error_count, s["t"].first_ns, s["t"].last_ns) == (3, 90, 5000)
    assert s["t"].avg_context_size == pytest.approx(4 / 3) and s["quiet"].error_count == 0
    terms = {r.term: r.n for r in errors.error_terms(err).collect()}
    assert terms["boom"] == 2 and "at" not in terms and terms["boom 0x1f"] == 1
