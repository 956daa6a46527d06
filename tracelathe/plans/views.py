"""The given ``events`` table read as runs: lines are rendered from it and parsed back.

One run per user; see FIXTURES.md for the definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelathe.operators import carry, parse
from tracelathe.plans.engine import Options, parse_tables
from tracelathe.session import materialize, spread
from tracelathe.sources.regression import label_runs

# Events of one user lie hours apart, so the windows are wider here.
BURST_GAP_NS = 6 * 3600 * 10 ** 9
CONTEXT_NS = 12 * 3600 * 10 ** 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_id, event_id, ts_ns, event_type, k, v, value; the session time zone plays no part."""
    micros = F.expr("datediff(to_date(ts), date'1970-01-01') * 86400000000L"
                    " + (hour(ts) * 3600L + minute(ts) * 60L) * 1000000L"
                    " + cast(extract(second from ts) * 1000000 as bigint)")
    return spread(table(spark, sf_dir, "events")).select(
        F.col("user_id").cast("string").alias("test_id"), "event_id", (micros * 1000).alias("ts_ns"),
        "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"), "value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered raw lines: per event an access, a transition when it has a predecessor, and an
    error for error events."""
    along = Window.partitionBy("test_id", "fsm").orderBy("event_id")
    ev = carry.by_run_size(
        events(spark, sf_dir).withColumn("fsm", F.col("k") % 2),
        lambda runs: runs.withColumn("prev", F.lag(F.struct("event_type")).over(along)),
        lambda large: carry.with_previous(carry.log_chunks(large, line="event_id"), ["test_id", "fsm"], ["event_id"], ["event_type"]).drop(carry.CHUNK),
        counted=table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("test_id")))
    access = F.concat(
        F.lit("["), "ts_ns", F.when(F.col("k") % 2 == 0, "] MEM_R [0x").otherwise("] MEM_W [0x"),
        F.lower(F.hex(F.col("k") + 4096)), F.lit("] 32b core."), "event_type", F.lit("["), F.col("k") % 4,
        F.lit("] 0x"), F.lower(F.hex("v")), F.lit(" <-- ev "), "event_id")
    step = F.when(F.col("prev").isNotNull(), F.concat(
        F.lit("FSM F"), F.col("fsm"), F.lit(": "), F.col("prev.event_type"), F.lit(" -> "), "event_type"))
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR: fault k="), "k"))
    return (ev.select("test_id", "event_id", F.posexplode(F.array(access, step, error)).alias("i", "raw"))
            .where("raw is not null")
            .select("test_id", (F.col("event_id") * 4 + F.col("i")).alias("line_id"), "raw"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, two thirds of them over two to four lines; line ids are four times as large."""
    whole = tables(spark, sf_dir)["lines"]
    kind = F.expr("line_id div 4 % 3")
    at = (F.when(kind == 1, F.lit(r" (?=MEM_)| (?=0x[0-9a-f]+ <--)|(?<=FSM) | (?=-> )")).when(kind == 2, F.lit(r" (?=<-- )|(?<= 32b) |(?<=-> )|(?<=ERROR:) ")).otherwise("\n"))
    return (whole.select("test_id", "line_id", F.posexplode(F.split("raw", at)).alias("i", "raw"))
            .select("test_id", (F.col("line_id") * 4 + F.col("i")).alias("line_id"), "raw"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.select("test_id", F.when((F.col("event_type") == "error") & (F.col("value") > 200),
                                       F.concat(F.lit("UVM_Error @"), "ts_ns")).otherwise("note").alias("raw"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = events(spark, sf_dir).select("test_id").distinct()
    return label_runs(listed, run_log(spark, sf_dir)).select(
        "test_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("log_path"), "status")


_TABLES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """runs, lines, access, fsm, err: rendered, parsed and stored once per session, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        raw = spread(materialize(lines(spark, sf_dir), "lines"))
        _TABLES[key] = {"lines": raw, "runs": materialize(runs(spark, sf_dir), "runs"),
                        **parse_tables(raw, Options(ts_source="record"))}
    return _TABLES[key]


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return parse.analysis_frame(t["access"], t["fsm"])
