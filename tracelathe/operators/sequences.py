"""Three-step access sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracelathe.functions.exprs import count_entropy
from tracelathe.operators import carry
from tracelathe.schema import TOP_AI_SEQUENCES, TOP_SEQUENCES


def sequence_windows(access: DataFrame, limit: int | None = None) -> DataFrame:
    """Sliding windows over a run's accesses in time order."""
    cols, shown = ["test_id", *carry.TIME_ORDER, "descr", "action", "value_hex"], ["descr", "action", "value_hex", "ts_ns"]

    def whole(rows):
        w = Window.partitionBy("test_id").orderBy(*carry.TIME_ORDER)
        return rows.select(*cols).withColumns({
            "next1": F.lead(F.struct(*shown), 1).over(w), "next2": F.lead(F.struct(*shown), 2).over(w),
            "order_no": F.row_number().over(w).cast("bigint")})

    def cut(rows):
        return carry.with_next_two(carry.time_chunks(rows).select(*cols, carry.CHUNK), ["test_id"], carry.TIME_ORDER, shown).drop(carry.CHUNK)

    ahead = carry.by_run_size(access, whole, cut, limit)
    three = lambda c: F.array(F.col(c), F.col(f"next1.{c}"), F.col(f"next2.{c}"))
    return ahead.where(F.col("next2").isNotNull()).select(
        "test_id", F.struct(*carry.TIME_ORDER).alias("start_pos"), "order_no",
        three("descr").alias("registers"), three("action").alias("actions"),
        three("value_hex").alias("values"), F.col("ts_ns").alias("start_ns"),
        F.col("next2.ts_ns").alias("end_ns"), (F.col("next2.ts_ns") - F.col("ts_ns")).alias("duration_ns"))


def sequence_counts(windows: DataFrame) -> DataFrame:
    return (windows.groupBy("test_id", F.array_join("registers", "->").alias("sequence"))
            .agg(F.count("*").alias("n"), F.min("order_no").alias("first_at")))


def top_sequences(counts: DataFrame, k: int = TOP_SEQUENCES) -> DataFrame:
    """Most frequent sequences per run; the one met first wins ties."""
    return carry.at_most(counts, ["test_id"], [F.desc("n"), F.asc("first_at")], k).drop("first_at")


def sequence_summary(counts: DataFrame, ai_sequences: DataFrame | None = None) -> DataFrame:
    """Totals, entropy and the top ten of each run; the intelligence step's sequences on request."""
    listed = lambda df: df.groupBy("test_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "sequence", "n"))).alias("top"))  # at most the top-k of a run
    out = (counts.groupBy("test_id").agg(F.sum("n").alias("total"), F.count("*").alias("n_unique"),
                                         count_entropy(F.col("n")).alias("entropy"))
           .join(listed(top_sequences(counts)), "test_id", "left"))
    if ai_sequences is not None:
        out = out.join(listed(ai_sequences).withColumnRenamed("top", "ai_top"), "test_id", "left")
    return out


TEXT_ORDER = ["ts_text", "line_id", "part", "pos"]


def ai_sequences(frame: DataFrame, k: int = TOP_AI_SEQUENCES, order="text") -> DataFrame:
    """Top sequences over accesses and transitions.  Times sort as text by default ("10" < "9");
    ``order='numeric'`` sorts them as numbers."""
    if order not in ("text", "numeric"):
        raise ValueError(f"unknown order {order!r}")
    by = TEXT_ORDER if order == "text" else ["ts_ns", *TEXT_ORDER[1:]]
    cut = carry.range_chunks(frame.select("test_id", *by, "descr"), ["test_id", *by], "text-order")
    ahead = carry.with_next_two(cut, ["test_id"], by, ["descr"]).where(F.col("next2").isNotNull())
    counts = (ahead.groupBy("test_id", F.concat_ws("->", "descr", "next1.descr", "next2.descr").alias("sequence"))
              .agg(F.count("*").alias("n"), F.min("order_no").alias("first_at")))
    return top_sequences(counts, k)
