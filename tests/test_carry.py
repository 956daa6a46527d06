"""Chunked ordered work equals plain windows, however small the chunks."""

import random

from pyspark.sql import Window, functions as F

from tracelathe.operators import carry
from tracelathe.operators.quantiles import exact_quantiles


def _rows(spark, n=200, seed=3):
    rnd = random.Random(seed)
    rows = [(("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(4)}"), i, rnd.randrange(20),
             rnd.choice([None, "a", "b"])) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, line_id long, v long, s string")


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_previous_next_running_last(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy("line_id")
    for lines in (1, 2, 3, 17, 1000):
        cut = carry.log_chunks(df, lines)
        _same(carry.with_previous(cut, ["k"], ["line_id"], ["v"]).select("k", "line_id", "prev.v"),
              df.select("k", "line_id", F.lag("v").over(w).alias("v")))
        two = carry.with_next_two(cut, ["k"], ["line_id"], ["v"])
        _same(two.select("k", "line_id", F.col("next1.v").alias("a"), F.col("next2.v").alias("b")),
              df.select("k", "line_id", F.lead("v", 1).over(w).alias("a"), F.lead("v", 2).over(w).alias("b")))
        _same(carry.with_running(cut, ["k"], ["line_id"], "v", "r").select("k", "line_id", "r"),
              df.select("k", "line_id", F.sum("v").over(w).alias("r")))
        _same(carry.with_last_known(cut, ["k"], ["line_id"], "s", "l").select("k", "line_id", "l"),
              df.select("k", "line_id", F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l")))


def test_range_chunks_follow_the_order(spark):
    df = _rows(spark)
    cut = carry.range_chunks(df, ["k", "v", "line_id"], "t", partitions=5)
    assert cut.select("chunk").distinct().count() > 2
    w = Window.partitionBy("k").orderBy("v", "line_id")
    _same(carry.with_previous(cut, ["k"], ["v", "line_id"], ["line_id"]).select("k", "line_id", F.col("prev.line_id").alias("p")),
          df.select("k", "line_id", F.lag("line_id").over(w).alias("p")))


def test_exact_quantiles(spark):
    df = _rows(spark).withColumn("v", F.col("v").cast("double"))
    got = exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95})
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in (("a", 0.05), ("b", 0.5), ("c", 0.95))])
    rounded = lambda d: d.select("k", *[F.round(c, 9).alias(c) for c in "abc"])
    _same(rounded(got), rounded(want))


def test_salted_join_and_attach(spark):
    df = carry.log_chunks(_rows(spark), 10)
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    plain = df.join(facts, "k").select("k", "line_id", "n")
    _same(carry.salted_join(df, facts, ["k"], ["line_id"]).select("k", "line_id", "n"), plain)
    _same(carry.attach(df, facts, ["k"]).select("k", "line_id", "n"), plain)


def test_keep_runs_both_ways(spark, monkeypatch):
    df = _rows(spark).withColumnRenamed("k", "test_id")
    ids = spark.createDataFrame([("hot",), ("k1",)], "test_id string")
    for limit in (200_000, 0):
        monkeypatch.setattr(carry, "BROADCAST_IDS", limit)
        _same(carry.keep_runs(df, ids).select("line_id"), df.where("test_id in ('hot', 'k1')").select("line_id"))
        _same(carry.keep_runs(df, ids, "left_anti").select("line_id"),
              df.where("test_id not in ('hot', 'k1')").select("line_id"))
