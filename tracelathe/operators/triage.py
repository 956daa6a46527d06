"""Expected behaviour from passing runs, deviations of failing runs, buckets and the report.

Input is the long feature table (test_id, status, family, entity, feature, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelathe.functions.exprs import masked
from tracelathe.operators import carry
from tracelathe.operators.quantiles import exact_quantiles
from tracelathe.schema import FAIL, PASS

KEY = ["family", "entity", "feature"]
Z_LIMIT = 3.0
NO_RECORDS = "(no records)"


def _bucket():
    return F.sha2(F.concat_ws("|", "message", "register"), 256)


def finite(features: DataFrame) -> DataFrame:
    """Finite values; rounded, so that equal features compare equal whatever order summed them."""
    return features.withColumn("value", F.round("value", 9)).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def learn_baseline(features: DataFrame) -> DataFrame:
    """Mean, deviation, p05/p95 and support of each feature over passing runs."""
    good = finite(features).where(F.col("status") == PASS)
    moments = good.groupBy(*KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                     F.count("*").alias("support"))
    return moments.join(exact_quantiles(good, KEY, "value", {"p05": 0.05, "p95": 0.95}), KEY)


def deviations(features: DataFrame, baseline: DataFrame, z_limit: float = Z_LIMIT) -> DataFrame:
    """Features of failing runs that lie more than ``z_limit`` deviations off or outside [p05, p95].

    z is null for a feature that all passing runs share one value of; any other value is outside."""
    bad = finite(features).where(F.col("status") == FAIL)
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std"))
    met = carry.salted_join(bad, baseline, KEY, ["test_id"]).withColumn("z", z)
    outside = (F.col("value") < F.col("p05")) | (F.col("value") > F.col("p95"))
    return (met.where((F.abs("z") > z_limit) | outside)
            .select("test_id", *KEY, "value", "mean", "std", "p05", "p95", "z", outside.alias("outside")))


def _strength() -> list:
    """From the strongest deviation down: values off a constant first, by their distance; then by deviations."""
    return [F.col("z").isNotNull().cast("int"), -F.round(F.coalesce(F.abs("z"), F.abs(F.col("value") - F.col("mean"))), 6)]


def unseen(found: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of failing runs whose ``keys`` no passing run shows (registers, sequences, edges)."""
    shown = found.select("test_id", *keys).distinct()
    status = runs.select("test_id", "status")
    held = carry.with_facts(shown, status, ["test_id"], keys, carry.few_rows(status))
    passes = held.groupBy(*keys).agg(F.count_if(F.col("status") == PASS).alias("_p")).where("_p = 0").drop("_p")
    return carry.salted_join(held.where(F.col("status") == FAIL).drop("status"), passes, keys, ["test_id"])


def signatures(runs: DataFrame, err: DataFrame, deviating: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Failing runs by masked first error message and most deviating register.

    With ``parsed`` (test_id) given, failing runs that are not in it share a message of their own."""
    first = err.groupBy("test_id").agg(
        F.min_by("message", F.struct("ts_ns", "line_id", "pos")).alias("message"))
    worst = (deviating.where(F.col("family") == "register_values")
             .groupBy("test_id").agg(
                 F.min_by("entity", F.struct(*_strength(), "entity", "feature")).alias("register"),
                 F.max(F.abs("z")).alias("max_z")))
    failing = runs.where(F.col("status") == FAIL).select("test_id")
    if parsed is None:
        failing = failing.withColumn("_parsed", F.lit(True))
    else:
        failing = failing.join(parsed.select("test_id").distinct().withColumn("_parsed", F.lit(True)), "test_id", "left")
    without = F.when(F.col("_parsed").isNull(), NO_RECORDS).otherwise("")
    return failing.join(first, "test_id", "left").join(worst, "test_id", "left").select(
        "test_id", F.coalesce(masked(F.col("message")), without).alias("message"),
        F.coalesce("register", F.lit("")).alias("register"),
        F.coalesce("max_z", F.lit(0.0)).alias("max_z"))  # of features that vary


def failure_buckets(signed: DataFrame) -> DataFrame:
    """Runs with the same signature; the representative is the smallest run id."""
    return signed.groupBy(_bucket().alias("bucket_id"), "message", "register").agg(
        F.count("*").alias("size"), F.min("test_id").alias("representative"), F.max("max_z").alias("max_z"))


def triage_report(buckets: DataFrame, signed: DataFrame, deviating: DataFrame, k: int | None = None) -> DataFrame:
    """The deviations of all runs of each bucket, the strongest first; only the first ``k`` if given.

    Values off what all passing runs share come first (their z is null), by distance.  A bucket may hold most
    failing runs: ranks are running counts along a range-sorted cut."""
    of_bucket = signed.select("test_id", _bucket().alias("bucket_id")).join(buckets.select("bucket_id", "size"), "bucket_id")
    rows = carry.salted_join(deviating, of_bucket, ["test_id"], KEY)
    order = ["_scaled", "_strength", "test_id", *KEY]
    rows = rows.withColumns(dict(zip(order, _strength()))).withColumn("_one", F.lit(1))
    cut = carry.range_chunks(rows, ["bucket_id", *order], "report")
    ranked = carry.with_running(cut, ["bucket_id"], order, "_one", "rank")
    return (ranked.where(F.col("rank") <= k) if k is not None else ranked).select(
        "bucket_id", "size", "test_id", "rank", *KEY, "value", "mean", "z")


def write_report(report: DataFrame, path: str, fmt="parquet") -> None:
    report.write.mode("overwrite").format(fmt).save(path)
