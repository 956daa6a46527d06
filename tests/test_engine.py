"""Regression directories end to end, and model storage."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tracelathe.operators import embed, forest
from tracelathe.plans import engine, features
from tracelathe.sources import models, regression


def _run(root, name, trace, log):
    d = os.path.join(root, name)
    os.makedirs(d)
    if trace is not None:
        path = os.path.join(d, "ptracker.log.gz")
        if isinstance(trace, bytes):
            with open(path, "wb") as f:
                f.write(trace)
        else:
            with gzip.open(path, "wb") as f:
                f.write("\n".join(trace).encode("utf-8", "surrogateescape"))
    if log is not None:
        with open(os.path.join(d, "jestr.log"), "w") as f:
            f.write(log)


def _trace(k):
    lines = []
    for i in range(60):
        lines.append(f"[{1000 + i * 700}] MEM_{'RW'[i % 2]} [0x{i % 8:x}] 32b core.reg[{i % 8}].f{(i + k) % 3} 0x{(i * (k + 3)) % 97:x} <-- n")
        if i % 6 == 0:
            lines.append(f"FSM pwr: S{i % 3} -> S{(i + 1) % 3}")
    return lines + (["UVM_ERROR : timeout at 0x1f code 12"] if k > 3 else [])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("regression dir+1 [x]{y}"))
    for k in range(4):
        _run(root, f"t_pass{k}", _trace(k), "all fine\n")
    _run(root, "t_fail", _trace(4), "note\nUvm_Error here\n")
    _run(root, "t_zero", _trace(5), "UVM_ERROR : 0\n")
    _run(root, "t_empty", _trace(1), "")
    _run(root, "t_unknown", _trace(1), None)
    _run(root, "t_notrace", None, "fine\n")
    _run(root, "t_badgz", b"not gzip at all", "uvm_error\n")
    _run(root, "t_cut", gzip.compress("\n".join(_trace(2) * 2000).encode())[:-2000], "uvm_error\n")
    _run(root, "t_twice", gzip.compress(b"[1] MEM_R [0x1] 32b a.b 0x1\r\n") + gzip.compress(b"[2] MEM_R [0x1] 32b a.b 0x2"), None)
    _run(root, "t_void", b"", None)
    _run(root, "t_silent", b"", "uvm_error\n")
    _run(root, "t_bytes", ["[1] MEM_R [0x1] 32b a\udcff.b 0x1"], "ok")
    with open(os.path.join(root, "plain.txt"), "w") as f:
        f.write("ignored")
    return root


def test_statuses(spark, root):
    runs = {r.test_id: r for r in regression.collect_runs(spark, root).collect()}
    assert {k: r.status for k, r in runs.items()} == {
        **{f"t_pass{k}": "PASS" for k in range(4)}, "t_fail": "FAIL", "t_zero": "FAIL", "t_empty": "PASS",
        "t_unknown": "UNKNOWN", "t_twice": "UNKNOWN", "t_void": "UNKNOWN", "t_badgz": "FAIL", "t_cut": "FAIL", "t_silent": "FAIL", "t_bytes": "PASS"}
    assert runs["t_fail"].log_path == os.path.join(root, "t_fail", "ptracker.log.gz")
    assert runs["t_fail"].path == os.path.join(root, "t_fail")
    df = regression.collect_runs(spark, root)
    assert {r.status: r.n for r in regression.status_counts(df).collect()} == {"PASS": 6, "FAIL": 5, "UNKNOWN": 3}
    assert regression.passing(df).count() == 6 and regression.failing(df).count() == 5
    assert [r.test_id for r in regression.runs_without_trace(spark, root).collect()] == ["t_notrace"]


def test_unreadable_traces_are_dropped_whole(spark, root):
    bad = {r.test_id for r in regression.unreadable(spark, root).collect()}
    assert bad == {"t_badgz", "t_cut"}
    lines = regression.read_traces(spark, root)
    assert not {"t_badgz", "t_cut"} & {r.test_id for r in lines.select("test_id").distinct().collect()}
    got = [r.raw for r in lines.where("test_id = 't_fail'").orderBy("line_id").collect()]
    assert got == _trace(4)
    assert lines.where("test_id = 't_twice'").count() == 2
    assert lines.where("test_id = 't_bytes'").first().raw == "[1] MEM_R [0x1] 32b a.b 0x1"


def test_split_traces_keep_their_order(spark, tmp_path):
    """A plain-text trace that Spark splits equals the same trace gzipped, line by line."""
    texts = [f"[{i}] MEM_R [0x{i:x}] 32b reg[{i % 5}] 0x{i:x}" if i % 3 else "" for i in range(20_000)]
    for name, trace in (("plain", "trace.log"), ("packed", "ptracker.log.gz")):
        os.makedirs(tmp_path / name / "t")
        with (gzip.open if trace.endswith("gz") else open)(tmp_path / name / "t" / trace, "wt") as f:
            f.write("\n".join(texts))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        plain = regression.read_traces(spark, str(tmp_path / "plain"), trace="trace.log", check=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    packed = regression.read_traces(spark, str(tmp_path / "packed"))
    rows = [tuple(r) for r in plain.orderBy("line_id").collect()]
    assert rows == [("t", i, x) for i, x in enumerate(texts)] == [tuple(r) for r in packed.orderBy("line_id").collect()]


def test_missing_root(spark, tmp_path):
    assert regression.collect_runs(spark, str(tmp_path / "none")).count() == 0
    assert engine.run(spark, str(tmp_path / "none")) is None


def test_whole_run(spark, root, tmp_path):
    out = engine.run(spark, root, str(tmp_path / "out"))
    parsed = {r.test_id for r in out["access"].select("test_id").distinct().collect()}
    assert "t_unknown" not in parsed and "t_cut" not in parsed and "t_fail" in parsed
    assert out["register_importance"].count() > 0 and "ai_importance" in out["access"].columns
    long = out["run_features"]
    assert {r.family for r in long.select("family").distinct().collect()} == set(features.FAMILIES)
    counted = {r.test_id for r in long.select("test_id").distinct().collect()}
    assert parsed < counted and counted - parsed == {"t_silent"}  # an empty trace has no records, but counts
    assert long.where("test_id = 't_silent' AND feature = 'error_count'").first().value == 0.0
    buckets = out["failure_buckets"].collect()
    assert sum(b.size for b in buckets) == 5
    assert {b.message for b in buckets} == {"timeout at <hex> code <n>", "(no records)"}
    assert [b.size for b in buckets if b.message == "(no records)"] == [3]
    assert spark.read.parquet(str(tmp_path / "out" / "triage_report")).count() == out["triage_report"].count() > 0
    assert spark.read.json(str(tmp_path / "out" / "failure_buckets")).count() == len(buckets)
    for name in ("unseen_registers", "unseen_sequences", "unseen_edges", "register_anomalies", "access_clusters"):
        out[name].count()
    assert {(r.test_id, r.message) for r in out["err"].collect()} == {(t, m) for t in ("t_fail", "t_zero") for m in ("timeout at 0x1f code 12",)}
    assert {r.term for r in out["error_terms"].collect()} >= {"timeout"} and out["error_context"].count() == 2
    assert out["error_context_rows"].count() == sum(r.context_size for r in out["error_context"].collect())
    assert out["fsm_edges"].where("test_id = 't_fail'").agg(F.sum("n")).first()[0] == 10 and out["state_visits"].where("test_id = 't_fail'").agg(F.sum("visits")).first()[0] == 11
    assert {r.cycle for r in out["fsm_cycles"].where("test_id = 't_fail'").collect()} <= {"S0->S1", "S0->S1->S2", "S1->S2", "S0->S2"}
    assert out["sequence_windows"].where("test_id = 't_fail'").count() == 58 == out["sequence_counts"].where("test_id = 't_fail'").agg(F.sum("n")).first()[0]


def test_without_intelligence_and_selected_families(spark, root):
    out = engine.run(spark, root, options=engine.Options(use_ai=False, families=["register_values", "error_contexts"]))
    assert "register_importance" not in out and "ai_importance" not in out["access"].columns
    assert {r.family for r in out["run_features"].select("family").distinct().collect()} == {"register_values", "error_contexts"}
    with pytest.raises(ValueError):
        features.extract_features({k: out["runs"] for k in ("runs", "access", "fsm", "err")}, ["nonsense"])


def test_nothing_failed(spark, tmp_path):
    _run(str(tmp_path), "only", _trace(0), "fine")
    assert engine.run(spark, str(tmp_path)) is None


def test_models_round_trip(spark, access_of, tmp_path):
    access = access_of([(f"t{i}", j, "R", f"u{(i * j) % 5}.r[{j % 4}]", i + j) for i in range(6) for j in range(12)])
    out, fit, vocab = embed.run_embeddings(access)
    rows = spark.createDataFrame([("t", f"r{i}", float(i % 7), float(i)) for i in range(30)], "test_id string, descr string, a double, b double")
    trees = forest.isolation_forest(rows, ["test_id"], ["descr"], ["a", "b"], n_trees=10)
    path = str(tmp_path / "models")
    models.save_models(path, fit, vocab, {"value": (trees, ["test_id"])})
    again = models.load_projection(path)
    vec = spark.createDataFrame([(1, [float(i) for i in range(again.pca.pc.numRows)])], "i int, vector array<double>")
    from pyspark.ml.functions import array_to_vector
    ready = vec.withColumn("_v", array_to_vector("vector"))
    assert again.transform(ready).first().embedding == pytest.approx(fit.transform(ready).first().embedding)
    loaded = models.load_forest(spark, path, "value")
    score = lambda f: sorted((r.descr, r.score) for r in forest.forest_scores(rows, f, ["test_id"], ["descr"], ["a", "b"]).collect())
    assert score(loaded) == score(trees)
    assert spark.read.parquet(f"{path}/forest/value/nodes").where(F.col("node") == 1).count() == 10
