"""Errors and the accesses just before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracelathe.operators import carry
from tracelathe.operators.text import stop_words
from tracelathe.schema import CONTEXT_NS

TOP_ERROR_TERMS = 10


def context_sizes(access: DataFrame, err: DataFrame, window_ns: int = CONTEXT_NS, limit: int | None = None) -> DataFrame:
    """Accesses within ``window_ns`` before (and at) each error time, counted.

    No pairs are formed: along the time line of a run, the count is what has passed by the error
    less what had passed before the window opened.  Work stays linear for any window.
    """
    at = lambda df, ts, kind, n, err_ns: df.select(
        "test_id", ts.alias("ts"), F.lit(kind).alias("kind"), n.alias("n"), err_ns.alias("err_ns"))
    none, err_ns = F.lit(None).cast("bigint"), F.col("err_ns")
    instants = access.groupBy("test_id", "ts_ns").agg(F.count("*").alias("n"))
    times = err.select("test_id", F.col("ts_ns").alias("err_ns")).distinct()
    # Kind orders equal times: a window opens before the accesses of its instant, an error comes after.
    line = (at(times, err_ns - window_ns, 0, F.lit(0), err_ns)
            .unionByName(at(instants, F.col("ts_ns"), 1, F.col("n"), none))
            .unionByName(at(times, err_ns, 2, F.lit(0), err_ns)))
    order = ["ts", "kind"]
    along = Window.partitionBy("test_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    passed = carry.by_run_size(
        line, lambda runs: runs.withColumn("passed", F.sum("n").over(along)),
        lambda large: carry.with_running(carry.range_chunks(large, ["test_id", *order], "time-line"), ["test_id"], order, "n", "passed").drop(carry.CHUNK),
        limit, access.select("test_id").unionByName(err.select("test_id")).unionByName(err.select("test_id")))
    signed = F.when(F.col("kind") == 2, F.col("passed")).otherwise(-F.col("passed"))
    return (passed.where("kind <> 1").groupBy("test_id", "err_ns").agg(F.sum(signed).alias("context_size")))


def error_context(access: DataFrame, err: DataFrame, window_ns: int = CONTEXT_NS) -> DataFrame:
    """Errors with the size of their context, empty contexts included."""
    sizes = context_sizes(access, err, window_ns).withColumnRenamed("err_ns", "ts_ns")
    return (carry.salted_join(err, sizes, ["test_id", "ts_ns"], ["line_id", "pos"])
            .select("test_id", "line_id", "pos", "ts_ns", "message", "context_size"))


def context_rows(access: DataFrame, err: DataFrame, window_ns: int = CONTEXT_NS,
                 salts: int = 16, limit: int | None = None) -> DataFrame:
    """The context itself: one row per (error instant, access).
    Each error time probes the time cell it lies in and the one before.  The accesses of runs of more than ``limit``
    accesses and errors (a chunk's share of a salt) are spread over salts; only for them is an error time repeated for each."""
    times = (err.select("test_id", F.col("ts_ns").alias("err_ns")).distinct()
             .withColumn("cell", F.explode(F.expr(f"array(err_ns div {window_ns} - 1, err_ns div {window_ns})"))))
    rows = access.withColumn("cell", F.expr(f"ts_ns div {window_ns}"))
    met = carry.by_run_size(
        rows, lambda runs: times.join(runs, ["test_id", "cell"]),
        lambda large: carry.salted_join(
            large, times.join(large.select("test_id").distinct(), "test_id", "left_semi"), ["test_id", "cell"], ["line_id", "pos"], salts=salts),
        limit or carry.CHUNK_LINES // salts, access.select("test_id").unionByName(err.select("test_id")))
    shown = ["test_id", "err_ns", "line_id", "pos", "ts_ns", "action", "address", "descr", "value_hex", "comment"]
    return met.where(F.col("ts_ns").between(F.col("err_ns") - window_ns, F.col("err_ns"))).select(*shown)


def error_summary(runs: DataFrame, access: DataFrame, err: DataFrame,
                  window_ns: int = CONTEXT_NS) -> DataFrame:
    """Count, first and last time and mean context size; runs without errors count 0."""
    per_instant = err.groupBy("test_id", F.col("ts_ns").alias("err_ns")).agg(F.count("*").alias("_n"))
    met = per_instant.join(context_sizes(access, err, window_ns), ["test_id", "err_ns"])
    found = met.groupBy("test_id").agg(
        F.sum("_n").alias("error_count"), F.min("err_ns").alias("first_ns"), F.max("err_ns").alias("last_ns"),
        (F.sum(F.col("_n") * F.col("context_size")) / F.sum("_n")).alias("avg_context_size"))
    return (runs.select("test_id").join(found, "test_id", "left")
            .withColumn("error_count", F.coalesce("error_count", F.lit(0))))


def error_messages(err: DataFrame) -> DataFrame:
    """The messages in time order; kept as rows, since a run may hold any number of them."""
    return err.select("test_id", "ts_ns", "line_id", "pos", "message")


def error_terms(err: DataFrame, k: int = TOP_ERROR_TERMS) -> DataFrame:
    """Most common words and in-message word pairs per run.

    Equal messages are counted once with their number before words are taken.
    """
    stop = stop_words(err.sparkSession)
    words = F.filter(F.regexp_extract_all(F.lower("message"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
                     lambda w: ~w.isin(stop))
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1),
                        lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    counted = (err.groupBy("test_id", "message").agg(F.count("*").alias("_m"))
               .withColumn("_w", words)
               .select("test_id", "_m", F.explode(F.when(F.size("_w") > 1, F.concat("_w", pairs))
                                                  .otherwise(F.col("_w"))).alias("term"))
               .groupBy("test_id", "term").agg(F.sum("_m").alias("n")))
    return carry.at_most(counted, ["test_id"], [F.desc("n"), F.asc("term")], k)
