"""Read/write balance, access intervals and bursts per register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelathe.functions.exprs import ratio_or_inf
from tracelathe.operators import carry
from tracelathe.operators.registers import REG
from tracelathe.schema import BURST_GAP_NS, MIN_ACCESSES


def rw_ratio(access: DataFrame) -> DataFrame:
    return (access.groupBy(*REG).agg(F.count_if("is_read").alias("reads"),
                                     F.count_if("is_write").alias("writes"))
            .withColumn("rw_ratio", ratio_or_inf(F.col("reads"), F.col("writes"))))


def kind_intervals(access: DataFrame, chunk_lines=None) -> DataFrame:
    """Mean and deviation of read and of write intervals, seconds, in log order."""
    cut = carry.log_chunks(access, chunk_lines or carry.CHUNK_LINES).select(
        *REG, "action", "is_read", "is_write", "ts_ns", "line_id", "pos", carry.CHUNK)
    gaps = carry.with_previous(cut, [*REG, "action"], carry.LOG_ORDER, ["ts_ns"],
                               tail_by=F.expr(carry.LOG_NUMBER))
    return gaps.groupBy(*REG).agg(*_by_kind(F.col("ts_ns") - F.col("prev.ts_ns")))


def _by_kind(gap: Column) -> list[Column]:
    read, write = F.when(F.col("is_read"), gap), F.when(F.col("is_write"), gap)
    return [
        (F.avg(read) / 1e9).alias("read_mean_interval"),
        (F.stddev_pop(read) / 1e9).alias("read_std_interval"),
        (F.avg(write) / 1e9).alias("write_mean_interval"),
        (F.stddev_pop(write) / 1e9).alias("write_std_interval")]


def timed_steps(access: DataFrame) -> DataFrame:
    """Accesses of each register with the one before in time."""
    cut = carry.time_chunks(access).select(*REG, *carry.TIME_ORDER, carry.CHUNK)
    return carry.with_previous(cut, REG, carry.TIME_ORDER, ["ts_ns"], tail_by=F.col("ts_ns"))


def all_intervals(steps: DataFrame) -> DataFrame:
    return (steps.groupBy(*REG).agg(*_overall(F.col("ts_ns") - F.col("prev.ts_ns")))
            .where(F.col("_n") >= MIN_ACCESSES).drop("_n"))


def _overall(gap: Column) -> list[Column]:
    span = F.max("ts_ns") - F.min("ts_ns")
    return [
        F.count("*").alias("_n"),
        (F.avg(gap) / 1e9).alias("mean_interval"), (F.stddev_pop(gap) / 1e9).alias("std_interval"),
        (F.max(gap) / 1e9).alias("max_interval"),
        F.when(span > 0, F.count("*") / (span / 1e9)).otherwise(0.0).alias("access_frequency")]


def interval_stats(access: DataFrame, chunk_lines=None) -> DataFrame:
    """Interval statistics of registers with >= 3 accesses."""
    return carry.by_run_size(access, _intervals_of_runs, lambda large: all_intervals(timed_steps(large)).join(
        kind_intervals(large, chunk_lines), REG), chunk_lines)


def _intervals_of_runs(access: DataFrame) -> DataFrame:
    """The same behind one shuffle by register."""
    rows = access.where("test_id is not null and descr is not null").select(*REG, "action", "is_read", "is_write", *carry.TIME_ORDER)
    before = lambda keys, order: F.lag("ts_ns").over(Window.partitionBy(*keys).orderBy(*order))
    steps = (rows.withColumn("_gap", F.col("ts_ns") - before(REG, carry.TIME_ORDER))
             .withColumn("_kind_gap", F.col("ts_ns") - before([*REG, "action"], carry.LOG_ORDER)))
    return (steps.groupBy(*REG).agg(*_overall(F.col("_gap")), *_by_kind(F.col("_kind_gap")))
            .where(F.col("_n") >= MIN_ACCESSES).drop("_n"))


def access_patterns(access: DataFrame, chunk_lines=None) -> DataFrame:
    """Ratios of every register, with interval statistics where it has enough accesses."""
    return rw_ratio(access).join(interval_stats(access, chunk_lines), REG, "left")


def bursts(access: DataFrame, gap_ns: int = BURST_GAP_NS, limit: int | None = None) -> DataFrame:
    """Maximal runs of >= 2 accesses to a register with gaps of at most ``gap_ns``."""
    starts = lambda before: F.when(F.col("ts_ns") - before <= gap_ns, 0).otherwise(1)

    def whole(rows):
        w = Window.partitionBy(*REG).orderBy(*carry.TIME_ORDER)
        steps = rows.select(*REG, *carry.TIME_ORDER).withColumn("_starts", starts(F.lag("ts_ns").over(w)))
        return _islands(steps.withColumn("burst", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))))

    def cut(rows):
        steps = timed_steps(rows).withColumn("_starts", starts(F.col("prev.ts_ns")))
        return _islands(carry.with_running(steps, REG, carry.TIME_ORDER, "_starts", "burst"))

    return carry.by_run_size(access, whole, cut, limit)


def _islands(numbered: DataFrame) -> DataFrame:
    return (numbered.groupBy(*REG, "burst").agg(
        F.count("*").alias("length"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))
        .where("length >= 2"))


def burst_stats(found: DataFrame) -> DataFrame:
    return found.groupBy(*REG).agg(
        F.count("*").alias("n_bursts"), F.avg("length").alias("mean_len"),
        F.max("length").alias("max_len"), F.sum("length").alias("total_accesses"))
