"""Per-register value statistics and vectors.  A register is (test_id, descr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracelathe.functions.exprs import digits
from tracelathe.operators import carry
from tracelathe.schema import HIST_BINS, MIN_ACCESSES

REG = ["test_id", "descr"]


def valid_values(access: DataFrame) -> DataFrame:
    """Rows whose value is a hex number."""
    return access.where(F.col("value_d").isNotNull())


def value_counts(access: DataFrame) -> DataFrame:
    """Occurrences of each distinct value; combined before the shuffle, so hot registers shrink.
    ``(key_len, key)`` sorts as the value does, at any width."""
    key = F.lower(digits(F.col("value_hex")))
    return (valid_values(access).groupBy(*REG, F.length(key).alias("key_len"), key.alias("key"))
            .agg(F.count("*").alias("n"), F.first("value_d").alias("value_d")))


def medians(counts: DataFrame) -> DataFrame:
    """Exact medians by running counts over range-cut values; no group is gathered."""
    cut = carry.range_chunks(counts, [*REG, "key_len", "key"], "value-order")
    totals = cut.groupBy(*REG).agg(F.sum("n").alias("_total")).where(f"_total >= {MIN_ACCESSES}")
    ran = carry.with_running(cut, REG, ["key_len", "key"], "n", "_upto")
    held = carry.attach(ran, totals, REG)
    lower, upper = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    holds = lambda p: (F.col("_upto") - F.col("n") < p) & (F.col("_upto") >= p)
    return (held.where(holds(lower) | holds(upper)).groupBy(*REG)
            .agg(F.avg("value_d").alias("median")))


def value_steps(access: DataFrame, chunk_lines=None) -> DataFrame:
    """Each value with the one before it in log order, and their difference."""
    rows = carry.log_chunks(valid_values(access), chunk_lines or carry.CHUNK_LINES).select(
        *REG, "line_id", "pos", carry.CHUNK, "value_hex", "value", "value_d", "value_bits")
    stepped = carry.with_previous(rows, REG, carry.LOG_ORDER,
                                  ["value_hex", "value", "value_d", "value_bits"])
    return with_difference(stepped)


def with_difference(stepped: DataFrame) -> DataFrame:
    """Adds ``diff``, from the value before (``prev``): exact where both are."""
    exact = F.lit(float(1 << 53))
    near = (F.col("value_d") < exact) & (F.col("prev.value_d") < exact)
    plain = F.col("value_d") - F.col("prev.value_d")
    return stepped.withColumn("diff", F.when(near, plain).otherwise(
        F.coalesce((F.col("value") - F.col("prev.value")).cast("double"), plain)))


def register_values(access: DataFrame, importance: DataFrame | None = None,
                    chunk_lines=None) -> DataFrame:
    """Statistics, bit statistics, differences and transitions per register with >= 3 values.

    ``importance`` (descr, importance) is attached when given, 0.0 otherwise.
    """
    out = carry.by_run_size(valid_values(access), _values_of_runs, lambda large: _values_of_chunks(large, chunk_lines), chunk_lines)
    if importance is None:
        return out.withColumn("importance", F.lit(0.0))
    return (carry.salted_join(out, importance, ["descr"], ["test_id"], "left")
            .withColumn("importance", F.coalesce("importance", F.lit(0.0))))


def _statistics() -> list:
    """Aggregates over the steps of a register."""
    bits, before = F.col("value_bits"), F.col("prev.value_bits")
    narrow = F.count("value_bits") == F.count("*")
    exact = F.count("value") == F.count("*")
    return [
        F.count("*").alias("n"),
        F.when(exact, F.min("value")).alias("min"),
        F.when(exact, F.max("value")).alias("max"),
        F.avg("value_d").alias("mean"),
        F.stddev_pop("value_d").alias("std"),
        F.when(exact, F.max("value") - F.min("value")).alias("range"),
        F.when(narrow, F.bit_or(bits)).alias("bits_ever"),
        F.when(narrow, F.bit_and(bits)).alias("bits_always"),
        F.when(narrow, F.bit_or(bits.bitwiseXOR(before))).alias("bits_toggled"),
        F.when(narrow, F.avg(F.bit_count(bits))).alias("mean_popcount"),
        F.when(narrow, F.avg(F.bit_count(bits.bitwiseXOR(before)))).alias("mean_hamming"),
        F.avg("diff").alias("mean_diff"),
        F.max(F.abs("diff")).alias("max_diff"),
        F.stddev_pop("diff").alias("diff_std"),
        (F.count_if(F.col("diff") != 0) / F.count("diff")).alias("change_frequency")]


def _values_of_runs(rows: DataFrame) -> DataFrame:
    """All statistics behind one shuffle: medians, values and pairs of values by their order within the register."""
    key = F.lower(digits(F.col("value_hex")))
    rows = rows.where("test_id is not null and descr is not null").select(
        *REG, *carry.LOG_ORDER, "value", "value_d", "value_bits", F.length(key).alias("key_len"), key.alias("key"))
    register = Window.partitionBy(*REG)
    steps = with_difference(rows.withColumn("prev", F.lag(F.struct("value", "value_d", "value_bits", "key")).over(register.orderBy(*carry.LOG_ORDER))))
    by_value, by_pair = register.orderBy("key_len", "key"), register.orderBy("_before", "key")
    steps = steps.withColumn("_before", F.col("prev.key")).withColumns({
        "_at": F.row_number().over(by_value), "_total": F.count("*").over(register),
        "_new": (~F.lag("key").over(by_value).eqNullSafe(F.col("key"))).cast("int")})
    steps = steps.withColumn("_pair", (F.col("_before").isNotNull() & ~(
        F.lag("_before").over(by_pair).eqNullSafe(F.col("_before")) & F.lag("key").over(by_pair).eqNullSafe(F.col("key")))).cast("int"))
    middle = (F.col("_at") == F.floor((F.col("_total") + 1) / 2)) | (F.col("_at") == F.floor((F.col("_total") + 2) / 2))
    return steps.groupBy(*REG).agg(
        *_statistics(), F.avg(F.when(middle, F.col("value_d"))).alias("median"),
        F.sum("_new").alias("n_unique"), F.sum("_pair").alias("n_transitions")).where(F.col("n") >= MIN_ACCESSES)


def _values_of_chunks(access: DataFrame, chunk_lines=None) -> DataFrame:
    steps = value_steps(access, chunk_lines)
    base = steps.groupBy(*REG).agg(*_statistics()).where(F.col("n") >= MIN_ACCESSES)
    counts = value_counts(access)
    distinct = counts.groupBy(*REG).agg(F.count("*").alias("n_unique"))
    pairs = value_transitions(steps)
    return base.join(medians(counts), REG).join(distinct, REG).join(pairs, REG)


def value_transitions(steps: DataFrame) -> DataFrame:
    """Distinct (previous, next) value pairs per register."""
    canon = lambda c: F.lower(digits(c))
    return (steps.where(F.col("prev").isNotNull())
            .groupBy(*REG, canon(F.col("prev.value_hex")).alias("_a"), canon(F.col("value_hex")).alias("_b"))
            .agg(F.lit(1).alias("_one")).groupBy(*REG).agg(F.count("*").alias("n_transitions")))


def access_vectors(access: DataFrame) -> DataFrame:
    """Counts, value moments and mean gaps (seconds, log order) of registers with >= 3 accesses.

    The mean of consecutive gaps is (last - first)/(n - 1), so one aggregation does.
    """
    # Log position as one number, which Spark can aggregate by hashing (a struct it would sort).
    at = F.expr(carry.LOG_NUMBER)

    def gap(flag):
        order = F.when(F.col(flag), at)
        n = F.count_if(flag)
        span = (F.max_by("ts_ns", order) - F.min_by("ts_ns", order)) / 1e9
        return F.when(n > 1, span / (n - 1)).otherwise(0.0)

    return (access.groupBy(*REG).agg(
        F.count_if("is_read").alias("reads"), F.count_if("is_write").alias("writes"),
        F.count("value_d").alias("n_values"),
        F.coalesce(F.avg("value_d"), F.lit(0.0)).alias("mean_value"),
        F.coalesce(F.stddev_pop("value_d"), F.lit(0.0)).alias("std_value"),
        gap("is_read").alias("read_gap"), gap("is_write").alias("write_gap"),
        F.min(at).alias("first_at"))
        .where(F.col("reads") + F.col("writes") >= MIN_ACCESSES))


ACCESS_DIMS = ["reads", "writes", "n_values", "mean_value", "std_value", "read_gap", "write_gap"]
VALUE_DIMS = ["mean", "std", "min", "max", "range", "entropy", "n"]


def standardise(vectors: DataFrame, dims: list[str], keys=("test_id",), ids=("descr",)) -> DataFrame:
    """Zero mean and unit population deviation per run; constant columns are only centred.

    Moments are aggregated map-side and joined back by salts, not windowed: a run's registers
    need not meet in one task.
    """
    keys = list(keys)
    moments = vectors.groupBy(*keys).agg(
        *[F.avg(d).alias(f"_m_{d}") for d in dims], *[F.stddev_pop(d).alias(f"_s_{d}") for d in dims])
    joined = carry.salted_join(vectors, moments, keys, list(ids))
    scale = lambda d: F.when(F.col(f"_s_{d}") > 0, F.col(f"_s_{d}")).otherwise(1.0)
    return (joined.withColumns({d: (F.col(d) - F.col(f"_m_{d}")) / scale(d) for d in dims})
            .drop(*[f"_m_{d}" for d in dims], *[f"_s_{d}" for d in dims]))


def value_entropy(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Entropy of a 10-bin equal-width histogram (last bin closed; equal values use one bin).

    ``bounds`` holds (test_id, descr, lo, hi); distinct values are spread over salts to meet it.
    """
    x, lo, hi = F.col("value_d"), F.col("lo"), F.col("hi")
    step = (hi - lo) / HIST_BINS
    rough = F.least(F.floor((x - lo) / (hi - lo) * HIST_BINS), F.lit(HIST_BINS - 1)).cast("int")
    edge = lambda i: lo + i * step
    bin_ = (F.when(hi == lo, F.lit(HIST_BINS // 2))
            .when(x < edge(F.col("_b")), F.col("_b") - 1)
            .when((F.col("_b") < HIST_BINS - 1) & (x >= edge(F.col("_b") + 1)), F.col("_b") + 1)
            .otherwise(F.col("_b")))
    binned = (carry.salted_join(counts, bounds, REG, ["key"])
              .withColumn("_b", F.when(hi > lo, rough)).withColumn("bin", bin_)
              .groupBy(*REG, "bin").agg(F.sum("n").alias("n")))
    total = F.sum("n")
    return binned.groupBy(*REG).agg(F.coalesce(
        F.greatest(F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total, F.lit(0.0)),
        F.lit(0.0)).alias("entropy"))


def value_vectors(access: DataFrame) -> DataFrame:
    """Value-distribution vector of registers with >= 3 values."""
    counts = value_counts(access)
    stats = (valid_values(access).groupBy(*REG).agg(
        F.avg("value_d").alias("mean"), F.stddev_pop("value_d").alias("std"),
        F.min("value_d").alias("min"), F.max("value_d").alias("max"),
        F.count("*").cast("double").alias("n"))
        .where(F.col("n") >= MIN_ACCESSES).withColumn("range", F.col("max") - F.col("min")))
    bounds = stats.select(*REG, F.col("min").alias("lo"), F.col("max").alias("hi"))
    return stats.join(value_entropy(counts, bounds), REG).select(*REG, *VALUE_DIMS)


def relative_seconds(frame: DataFrame) -> DataFrame:
    """Seconds since the run's first row; a 0-based row number (list order) where a run holds a
    time that is no number."""
    cut = carry.log_chunks(frame if "part" in frame.columns else frame.withColumn("part", F.lit(0)))
    facts = cut.groupBy("test_id").agg(
        F.min("ts_ns").alias("_t0"), (F.count("ts_ns") == F.count("*")).alias("_timed"))
    ordered = carry.with_running(
        carry.attach(cut, facts, ["test_id"]).withColumn("_one", F.lit(1)),
        ["test_id"], ["line_id", "part", "pos"], "_one", "_row")
    return (ordered.withColumn("relative_time", F.when(
        F.col("_timed"), (F.col("ts_ns") - F.col("_t0")) / 1e9).otherwise((F.col("_row") - 1).cast("double")))
        .drop("_t0", "_timed", "_one", "_row", carry.CHUNK))
