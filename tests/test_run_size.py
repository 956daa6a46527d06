"""Runs that fit a chunk are worked without a cut, behind one shuffle; the results are those of the cut."""

import random

import pytest
from pyspark.sql import functions as F

from tracelathe.operators import access_patterns as ap, activity, carry, errors, parse, registers, sequences, text, triage
from tracelathe.plans.features import assemble


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    norm = lambda x: f"{x:.9g}" if isinstance(x, float) else x
    return sorted(str(sorted((k, norm(v)) for k, v in r.asDict(True).items() if k not in ("order_no", "burst"))) for r in df.collect())


@pytest.fixture(scope="module")
def access(spark, access_of):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"t{rnd.randrange(6)}", rnd.randrange(300) * 400, rnd.choice("RW"),
             *rnd.choice([(f"r{rnd.randrange(3)}", rnd.choice([0, 1, 7, 2**32])), ("wide", 2**64 + rnd.randrange(4))])) for _ in range(240)]
    return access_of(rows).localCheckpoint()


@pytest.mark.parametrize("limit", [1, 60])
def test_cut_and_whole_runs_agree(spark, access, limit):
    err = access.where("line_id % 9 = 0").select("test_id", "line_id", "pos", "ts_ns", "ts_text", F.lit("e").alias("message"), "raw")
    for whole, cut in [
            (registers.register_values(access), registers.register_values(access, chunk_lines=limit)),
            (ap.interval_stats(access), ap.interval_stats(access, chunk_lines=limit)),
            (ap.bursts(access, 900), ap.bursts(access, 900, limit)),
            (sequences.sequence_windows(access), sequences.sequence_windows(access, limit)),
            (errors.context_sizes(access, err, 5000), errors.context_sizes(access, err, 5000, limit))]:
        assert _rows(whole) == _rows(cut) != []


def test_rows_of_no_run_are_cut_like_others(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "test_id string, x int")
    out = carry.by_run_size(df, lambda d: d.withColumn("how", F.lit("whole")), lambda d: d.withColumn("how", F.lit("cut")), 1)
    assert sorted((r.x, r.how) for r in out.collect()) == [(1, "cut"), (2, "cut"), (3, "whole")]


@pytest.mark.parametrize("make", [registers.register_values, ap.interval_stats, ap.bursts, lambda a: ap.burst_stats(ap.bursts(a))])
def test_small_runs_are_shuffled_once(access, make):
    assert _plan(make(access)).count("Exchange hashpartitioning") == 1


def test_marks_of_small_runs_are_shuffled_once(lines_of):
    marks = parse.stamped(parse.found(lines_of("[5] MEM_R [0x1] 32b a 0x1", "ERROR: x")).localCheckpoint())
    assert _plan(marks).count("Exchange hashpartitioning") == 1 and [r.ts_ns for r in marks.collect()] == [5]


def test_status_is_joined_before_features_become_rows(spark, access):
    runs = access.select("test_id", F.lit("PASS").alias("status")).distinct()
    features = {"register_values": registers.register_values(access)}
    plan = assemble(runs, features)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(array(struct(") < plan.index("Join Inner")
    assert assemble(runs, features).columns == ["test_id", "family", "entity", "feature", "value", "status"]


def test_words_and_bins_are_found_once(spark, access):
    docs = spark.createDataFrame([(1, "big red dog"), (2, "big cat"), (3, None)], "doc_id int, text string")
    weights = text.document_tfidf(docs, "doc_id", "text")
    assert "regexp_extract_all" not in _plan(weights) and "big red" in {r.term for r in weights.collect()}
    assert "map_from_entries" not in _plan(activity.run_activity(access))


def test_error_times_of_small_runs_are_not_repeated(spark, access):
    err = access.where("line_id % 9 = 0").select("test_id", "line_id", "pos", "ts_ns", "ts_text", F.lit("e").alias("message"), "raw")
    small, spread, some = (errors.context_rows(access, err, 5000, limit=n) for n in (None, 1, 60))
    assert "_salt" not in _plan(small) and "_salt" in _plan(spread)
    wanted = access.alias("a").join(err.select("test_id", F.col("ts_ns").alias("err_ns")).distinct().alias("e"), "test_id").where("ts_ns between err_ns - 5000 and err_ns")
    assert _rows(small) == _rows(spread) == _rows(some) == _rows(wanted.select(*small.columns)) != []


def test_status_of_many_runs_is_not_broadcast(spark, access, monkeypatch, tmp_path):
    """Spark judges stored runs by their compressed file, and salts don't count: only counted, few runs are broadcast."""
    spark.createDataFrame([(f"t{i}", "FAIL" if i % 3 else None) for i in range(6)] + [("hot", "PASS"), (None, "PASS")], "test_id string, status string"
                          ).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    wide = registers.register_values(access).localCheckpoint()
    features = {"register_values": wide, "register_sequences": wide.groupBy("test_id").agg(
        F.count("*").alias("total"), F.sum("n").alias("n_unique"), F.lit(0.5).alias("entropy")).localCheckpoint()}
    few = assemble(runs, features)
    assert _plan(few).count("BroadcastHashJoin") == 2 and "_salt" not in _plan(few)
    edges = wide.select("test_id", "descr")
    shown = triage.unseen(edges, runs, ["descr"])
    want, unseen = _rows(few), _rows(shown)
    monkeypatch.setattr(carry, "BROADCAST_IDS", 7)
    many = assemble(runs, features)
    assert "Broadcast" not in _plan(many) and _plan(many).count("_salt") > 0
    assert _rows(many) == want and len(want) > 20
    assert _rows(triage.unseen(edges, runs, ["descr"])) == unseen
