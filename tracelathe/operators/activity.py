"""Whole-run activity: rates, bins, phases, periodicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelathe.functions.exprs import ratio_or_inf
from tracelathe.operators import carry
from tracelathe.schema import MAX_LAG, N_BINS
from tracelathe.session import materialize


def run_totals(access: DataFrame) -> DataFrame:
    seconds = (F.max("ts_ns") - F.min("ts_ns")) / 1e9
    return (access.groupBy("test_id").agg(
        seconds.alias("duration_s"), F.count("*").alias("total"),
        F.when(seconds > 0, F.count("*") / seconds).otherwise(0.0).alias("rate"),
        F.count_if("is_read").alias("reads"), F.count_if("is_write").alias("writes"))
        .withColumn("rw_ratio", ratio_or_inf(F.col("reads"), F.col("writes"))))


def _bin(n_bins: int) -> Column:
    """Right-closed bins without the left edge, in integers: ceil(t * n / span) - 1."""
    t, span = F.col("ts_ns") - F.col("_t0"), F.col("_t1") - F.col("_t0")
    small = F.expr(f"((ts_ns - _t0) * {n_bins} + (_t1 - _t0) - 1) div (_t1 - _t0)")
    wide = F.expr(f"(cast(ts_ns - _t0 as decimal(38,0)) * {n_bins} + (_t1 - _t0) - 1) div "
                  "cast(_t1 - _t0 as decimal(38,0))")
    return F.when(t == 0, None).when(span < 10 ** 16, small).otherwise(wide) - 1


def bin_counts(access: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Reads and writes per occupied bin.  First-instant accesses fall in none; a run of one
    instant has no occupied bin."""
    cut = carry.time_chunks(access)
    spans = cut.groupBy("test_id").agg(F.min("ts_ns").alias("_t0"), F.max("ts_ns").alias("_t1"))
    return (carry.attach(cut, spans, ["test_id"]).withColumn("bin", _bin(n_bins).cast("int"))
            .where("bin is not null").groupBy("test_id", "bin")
            .agg(F.count_if("is_read").alias("reads"), F.count_if("is_write").alias("writes")))


def bin_arrays(access: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Dense arrays of reads and writes per bin (n_bins entries each)."""
    counts = bin_counts(access, n_bins)
    per_run = counts.groupBy("test_id").agg(F.map_from_entries(
        F.collect_list(F.struct("bin", F.struct("reads", "writes")))).alias("_m"))
    slots = F.sequence(F.lit(0), F.lit(n_bins - 1))
    dense = lambda f: F.transform(slots, lambda i: F.coalesce(F.try_element_at("_m", i)[f], F.lit(0)))
    runs = access.select("test_id").distinct()
    return runs.join(per_run, "test_id", "left").select(
        "test_id", dense("reads").alias("reads_by_bin"), dense("writes").alias("writes_by_bin"))


def dense_bins(arrays: DataFrame) -> DataFrame:
    return arrays.select("test_id", F.posexplode(F.arrays_zip("reads_by_bin", "writes_by_bin")).alias("bin", "_z")
                         ).select("test_id", "bin", F.col("_z.reads_by_bin").alias("reads"),
                                  F.col("_z.writes_by_bin").alias("writes"))


def _totals() -> Column:
    return F.zip_with("reads_by_bin", "writes_by_bin", lambda r, w: r + w)


def peak_bin(arrays: DataFrame) -> DataFrame:
    """The busiest bin, the first one on ties."""
    return arrays.select("test_id", (F.array_position(_totals(), F.array_max(_totals())) - 1)
                         .cast("int").alias("peak_bin"))


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def autocorrelation(series: Column, max_lag: int = MAX_LAG) -> Column:
    """r_0..r_max_lag of an array; zeros when it does not vary."""
    n = F.size(series)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)

    def at(c, k):
        return total(F.zip_with(F.slice(c, F.lit(1), n - k), F.slice(c, k + 1, n - k), lambda a, b: a * b))

    def lags(c, var):
        return F.transform(F.sequence(F.lit(0), F.lit(max_lag)),
                           lambda k: F.when(var > 0, at(c, k) / var).otherwise(0.0))

    return _let(total(series) / n, lambda mean: _let(
        F.transform(series, lambda v: v - mean), lambda c: _let(at(c, F.lit(0)), lambda var: lags(c, var))))


def periodicity(arrays: DataFrame) -> DataFrame:
    acf = arrays.select("test_id", autocorrelation(F.col("reads_by_bin")).alias("read_acf"),
                        autocorrelation(F.col("writes_by_bin")).alias("write_acf"))
    strong = lambda c: F.exists(F.slice(c, 2, MAX_LAG), lambda v: F.abs(v) > 0.5)
    return acf.withColumn("periodic", strong("read_acf") | strong("write_acf"))


def activity_phases(arrays: DataFrame) -> DataFrame:
    """Runs of bins with the same label: idle (none), high (above the mean), low (the rest).

    Every run has the same small number of bins, so windows by run are even.
    """
    total = F.col("reads") + F.col("writes")
    run = Window.partitionBy("test_id")
    labelled = dense_bins(arrays).withColumn("label", F.when(total == 0, "idle").when(
        total > F.avg(total).over(run), "high").otherwise("low"))
    starts = F.when(F.lag("label").over(run.orderBy("bin")) == F.col("label"), 0).otherwise(1)
    return (labelled.withColumn("_s", starts)
            .withColumn("phase", F.sum("_s").over(run.orderBy("bin")))
            .groupBy("test_id", "phase", "label").agg(
                F.min("bin").alias("start_bin"), F.max("bin").alias("end_bin"),
                F.avg("reads").alias("mean_reads"), F.avg("writes").alias("mean_writes")))


def run_activity(access: DataFrame) -> DataFrame:
    """All activity features, one row per run."""
    arrays = materialize(bin_arrays(access), "activity-bins")  # read four times
    phases = activity_phases(arrays).groupBy("test_id").agg(
        F.count("*").alias("n_phases"),
        F.array_sort(F.collect_list(F.struct("start_bin", "end_bin", "label", "mean_reads", "mean_writes")))
        .alias("phases"))
    return (run_totals(access).join(arrays, "test_id").join(peak_bin(arrays), "test_id")
            .join(phases, "test_id").join(periodicity(arrays), "test_id"))
