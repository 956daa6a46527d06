"""Exact linear quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelathe.operators import carry


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """One column per quantile, interpolated linearly between neighbours in rank.

    Rows are counted per distinct value first, so a value that most rows share is one row; values
    are then range-cut once and ranked by running counts, so no group meets in one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    cut = carry.range_chunks(counted, [*keys, value], "quantiles")
    ranked = carry.with_running(cut, keys, [value], "_w", "_upto")
    totals = cut.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    held = carry.attach(ranked, totals, keys)
    holds = lambda rank: (F.col("_upto") - F.col("_w") <= rank) & (rank < F.col("_upto"))
    wanted, aggs, out = F.lit(False), [], []
    for name, q in qs.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        low, high = holds(F.floor(h)), holds(F.ceil(h))
        wanted = wanted | low | high
        aggs += [F.max(F.when(low, F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(high, F.col(value))).alias(f"_hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"_f_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return held.where(wanted).groupBy(*keys).agg(*aggs).select(*keys, *out)
