"""Ordered work on groups of any size.

A window over a whole run (or one register of it) would sort a third of the data in one task
when one run is that large.  Here each group is cut into chunks that follow its order; windows
run inside a chunk, and one small row per (group, chunk) carries what crosses the seam.

Log order is cut by line id, which needs no data pass.  Any other order is cut by Spark's range
partitioner, and the result is written so that the cut stays the same for all its readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelathe.schema import CHUNK_LINES
from tracelathe.session import materialize

CHUNK = "chunk"
LOG_ORDER = ["line_id", "pos"]
# The same order as one number, for any BIGINT line id (up to 2^18 records a line).
LOG_NUMBER = "CAST(line_id AS DECIMAL(20, 0)) * 262144 + pos"


def log_chunks(df: DataFrame, lines: int = CHUNK_LINES, line="line_id") -> DataFrame:
    """Cut by line id: chunk ``i`` holds lines ``[i*lines, (i+1)*lines)``."""
    return df.withColumn(CHUNK, F.expr(f"{line} div {lines}"))


def range_chunks(df: DataFrame, order: list[str], name: str, partitions: int | None = None, finish=None) -> DataFrame:
    """Cut by sorted ranges of ``order`` (group columns first); balanced whatever the keys hold.

    ``finish`` (DataFrame -> DataFrame, narrow, keeping ``chunk``) works on the rows behind the shuffle: what it adds is
    neither sampled nor shuffled."""
    cut = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
    cut = cut.withColumn(CHUNK, F.spark_partition_id().cast("bigint"))
    return materialize(finish(cut) if finish else cut, name)


def by_run_size(df: DataFrame, whole, cut, limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``whole`` of the rows of runs with at most ``limit`` rows (a chunk's), ``cut`` of those of larger runs, as one table.

    A run that fits a chunk needs no cut: windows and aggregates by its keys share one shuffle and no seam is looked
    for.  ``counted`` (test_id) are the rows that tell the sizes, where that isn't ``df``."""
    sizes = (df if counted is None else counted).groupBy("test_id").agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > (limit or CHUNK_LINES)).select(F.col("test_id").alias("_large")), "large-runs")
    if large.isEmpty():
        return whole(df)
    among = F.col("test_id").eqNullSafe(F.col("_large"))
    return whole(df.join(large, among, "left_anti")).unionByName(cut(df.join(large, among, "left_semi")))


def _row(cols) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                  out: str = "prev", tail_by: Column | None = None) -> DataFrame:
    """Add ``out``: struct of ``cols`` from the row before within ``keys`` (null on the first).

    ``tail_by``, a number that rises with ``order`` (rows it ties must agree in ``cols``), lets
    Spark find each chunk's last row by hashing when ``cols`` are numbers too.
    """
    inside = df.withColumn(
        out, F.lag(_row(cols)).over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    tail = (F.max_by(_row(cols), _row(order)) if tail_by is None
            else F.struct(*[F.max_by(c, tail_by).alias(c) for c in cols]))
    tails = df.groupBy(*keys, CHUNK).agg(tail.alias("_tail"))
    seams = (tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK)))
             .where(F.col("_carry").isNotNull()).drop("_tail"))
    return (inside.join(seams, [*keys, CHUNK], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_carry"))


def with_next_two(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Add ``next1`` and ``next2``: structs of ``cols`` from the two rows after within ``keys``.

    ``order_no`` is added too: one number that rises along the order, which Spark can aggregate
    by hashing where it would sort for a struct.
    """
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    inside = df.withColumns({
        "_l1": F.lead(_row(cols), 1).over(w), "_l2": F.lead(_row(cols), 2).over(w),
        "order_no": F.col(CHUNK) * F.lit(1 << 33) + F.row_number().over(w)})
    heads = (df.select(*keys, CHUNK, _row(cols).alias("_head"), F.row_number().over(w).alias("_rn"))
             .where("_rn <= 2"))
    along = Window.partitionBy(*keys).orderBy(CHUNK, "_rn")
    seams = (heads
             .withColumn("_h1", F.lead("_head", 1).over(along))
             .withColumn("_h2", F.lead("_head", 2).over(along))
             .withColumn("_h3", F.lead("_head", 3).over(along))
             .withColumn("_heads", F.max("_rn").over(Window.partitionBy(*keys, CHUNK)))
             .where("_rn = 1")
             .select(*keys, CHUNK,
                     F.when(F.col("_heads") > 1, F.col("_h2")).otherwise(F.col("_h1")).alias("_c1"),
                     F.when(F.col("_heads") > 1, F.col("_h3")).otherwise(F.col("_h2")).alias("_c2"))
             .where(F.col("_c1").isNotNull()))
    return (inside.join(seams, [*keys, CHUNK], "left")
            .withColumn("next1", F.coalesce(F.col("_l1"), F.col("_c1")))
            .withColumn("next2", F.coalesce(
                F.col("_l2"), F.when(F.col("_l1").isNotNull(), F.col("_c1")).otherwise(F.col("_c2"))))
            .drop("_l1", "_l2", "_c1", "_c2"))


def with_running(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: sum of ``amount`` over the rows up to and including this one within ``keys``."""
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumn(out, F.sum(amount).over(w))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seams = (df.groupBy(*keys, CHUNK).agg(F.sum(amount).alias("_sum"))
             .select(*keys, CHUNK, F.sum("_sum").over(before).alias("_carry"))
             .where("_carry is not null"))
    return (inside.join(seams, [*keys, CHUNK], "left")
            .withColumn(out, F.col(out) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry"))


def with_last_known(df: DataFrame, keys: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """Add ``out``: the latest non-null ``col`` of the rows before this one within ``keys``."""
    w = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    inside = df.withColumn(out, F.last(col, ignorenulls=True).over(w))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    seams = (df.groupBy(*keys, CHUNK)
             .agg(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), _row(order))).alias("_tail"))
             .select(*keys, CHUNK, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
             .where("_carry is not null"))
    return (inside.join(seams, [*keys, CHUNK], "left")
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_carry"))


def at_most(df: DataFrame, keys: list[str], order: list[Column], k: int, out="rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle as well."""
    return (df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col(out) <= k))


def time_chunks(access: DataFrame) -> DataFrame:
    """Cut by time within runs.  A stored access table carries its cut in ``tchunk`` already."""
    if "tchunk" in access.columns:
        return access.withColumn(CHUNK, F.col("tchunk"))
    return range_chunks(access, ["test_id", *TIME_ORDER], "time-order")


TIME_ORDER = ["ts_ns", "line_id", "pos"]


def attach(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row of facts per group to chunked rows; no join key holds more than a chunk."""
    cells = df.select(*keys, CHUNK).distinct().join(facts, keys)
    return df.join(cells, [*keys, CHUNK])


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
                how="inner", salts: int = 16) -> DataFrame:
    """Equi-join where one key may hold much of ``big``: its rows are spread over salts and the
    (bounded per key) rows of ``small`` repeated for each."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


# Run ids that may be broadcast: at most this many rows of a short string.
BROADCAST_IDS = 200_000


def with_facts(big: DataFrame, facts: DataFrame, keys: list[str], spread_by: list[str], few: bool) -> DataFrame:
    """Equi-join to a stored table of one short row per key.

    ``few`` rows are broadcast as they are.  More are sort-merged, salted where ``spread_by`` tells rows of a key apart:
    Spark judges them by the bytes of their compressed file, without the salts' repetition, and would broadcast them."""
    if few:
        return big.join(F.broadcast(facts), keys)
    return salted_join(big, facts.hint("merge"), keys, spread_by) if spread_by else big.join(facts.hint("merge"), keys)


def few_rows(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df``, a stored table, has at most ``most`` rows, ``BROADCAST_IDS`` if not given."""
    most = BROADCAST_IDS if most is None else most
    return df.limit(most + 1).count() <= most


def keep_runs(df: DataFrame, runs: DataFrame, how="left_semi") -> DataFrame:
    """Rows of the given runs (or, with ``left_anti``, of the others).

    Few run ids are broadcast after counting them, so that raw text is not shuffled to be
    filtered; more go through a salted join.
    """
    ids = runs.select("test_id").distinct()
    if few_rows(ids):
        return df.join(F.broadcast(ids), "test_id", how)
    return salted_join(df, ids, ["test_id"], ["line_id"], how)
