"""From a regression directory (or its raw lines) to triage tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelathe.operators import carry, errors, evidence, fsm as machines, parse, sequences, spanning, triage
from tracelathe.plans.features import assemble, extract_features
from tracelathe.schema import BURST_GAP_NS, CONTEXT_NS
from tracelathe.session import materialize
from tracelathe.sources import regression


@dataclass(frozen=True)
class Options:
    use_ai: bool = True
    families: list[str] | None = None
    dedupe_sleep: bool = False
    ts_source: str = "nearest"
    whole_text: bool = False
    burst_gap_ns: int = BURST_GAP_NS
    context_ns: int = CONTEXT_NS
    check_traces: bool = True


def parse_tables(lines: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """Typed tables, written once.  Accesses are range-sorted by run and time on the way, and keep
    the cut (``tchunk``) that all time-ordered operators work along.

    The text is scanned once, into a table of what each line holds; it is read again only where lines bear
    signs of records that span them, and only the lines of such records are matched anew."""
    records = materialize(parse.found(lines, options.ts_source, spanning.signs(F.col("raw"))), "records")
    if not records.where("sign").isEmpty():
        shared = spanning.members(lines)
        if shared is not None:
            anew = materialize(parse.found(spanning.texts(lines, shared), options.ts_source), "records")
            records = spanning.without(records, shared).unionByName(anew)
    access = carry.range_chunks(parse.access_records(records), ["test_id", *carry.TIME_ORDER], "access",
                                finish=lambda cut: parse.typed_access(cut.withColumnRenamed(carry.CHUNK, "tchunk"), "tchunk"))
    marks = materialize(parse.stamped(records), "marks")
    return {"access": access, "fsm": materialize(parse.transitions(marks, options.dedupe_sleep), "fsm"),
            "err": materialize(parse.messages(marks), "err")}


def analyse(runs: DataFrame, lines: DataFrame, options: Options = Options(),
            unreadable: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result table for runs whose lines are given.

    Passing and failing runs go through one job with their status as a column.  Runs of unknown
    status are not parsed.  Runs in ``unreadable`` (test_id) have no tokens and take no part in the
    features; a run without lines that isn't among them has an empty trace and counts as such.
    """
    chosen = runs.where(F.col("status").isin("PASS", "FAIL"))
    tables = parse_tables(carry.keep_runs(lines, chosen), options)
    access, fsm, err = tables["access"], tables["fsm"], tables["err"]
    out = dict(tables)
    importance = ai_top = None
    if options.use_ai:
        found = evidence.extract_intelligence(access, parse.analysis_frame(access, fsm))
        found = {k: materialize(v, k.replace("_", "-")) for k, v in found.items()}
        out |= found
        importance = evidence.corpus_importance(found["register_importance"])
        ai_top = found["ai_sequences"]
        out["access"] = evidence.tag_importance(access, found["register_importance"])
    read = chosen if unreadable is None else chosen.join(unreadable.select("test_id"), "test_id", "left_anti")
    parsed = materialize(read, "parsed-runs")
    features = extract_features({**tables, "runs": parsed}, options.families, importance=importance,
                                ai_sequences=ai_top, burst_gap_ns=options.burst_gap_ns,
                                context_ns=options.context_ns)
    out |= features
    out["run_features"] = materialize(assemble(parsed, features), "run-features")
    baseline = materialize(triage.learn_baseline(out["run_features"]), "baseline")
    deviating = materialize(triage.deviations(out["run_features"], baseline), "deviations")
    signed = materialize(triage.signatures(chosen, err, deviating, lines.select("test_id").distinct()), "signatures")
    buckets = triage.failure_buckets(signed)
    edges = materialize(machines.transitions(fsm), "edges")
    steps = sequences.sequence_windows(access)
    windows = sequences.sequence_counts(steps)
    return out | {
        "sequence_windows": steps, "sequence_counts": windows, "fsm_edges": edges, "state_visits": machines.state_visits(edges),
        "fsm_cycles": machines.cycles(edges), "error_context": errors.error_context(access, err, options.context_ns),
        "error_context_rows": errors.context_rows(access, err, options.context_ns), "error_terms": errors.error_terms(err),
        "baseline": baseline, "deviations": deviating,
        "unseen_registers": triage.unseen(access, parsed, ["descr"]),
        "unseen_sequences": triage.unseen(windows, parsed, ["sequence"]),
        "unseen_edges": triage.unseen(edges, parsed, ["fsm_name", "from_state", "to_state"]),
        "failure_buckets": buckets, "triage_report": triage.triage_report(buckets, signed, deviating),
    }


def run(spark: SparkSession, root: str, out_dir: str | None = None,
        options: Options = Options()) -> dict[str, DataFrame] | None:
    """The whole analysis of a regression directory; None when nothing failed."""
    runs = materialize(regression.collect_runs(spark, root), "runs")
    if not regression.has_failures(runs):
        return None
    chosen = runs.where(F.col("status").isin("PASS", "FAIL"))
    bad = materialize(regression.unreadable(spark, root), "unreadable") if options.check_traces else None
    lines = regression.read_traces(spark, root, chosen, whole_text=options.whole_text, check=options.check_traces, bad=bad)
    results = {"runs": runs, **analyse(runs, lines, options, bad)}
    if out_dir:
        triage.write_report(results["triage_report"], f"{out_dir}/triage_report")
        triage.write_report(results["failure_buckets"], f"{out_dir}/failure_buckets", "json")
    return results
