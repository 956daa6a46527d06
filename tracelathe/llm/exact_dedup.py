"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by their length and first bytes, groups with one member are done, and the
others are split by the next bytes, until a group has one member or its texts have ended.  Texts
are compared byte by byte; nothing rests on a digest.  Digits widen eightfold from level to
level, so that even the longest text takes about ten levels, and only documents that still have a
possible twin are carried along.

A level counts its groups (combined before the shuffle, so a group that holds a third of all rows
costs one row per task) and joins the counts back; adaptive execution splits the rows of a hot
group in that join.  No group ever meets in one task.  Joins that move texts ask for a merge join:
the groups grow with the input, so a plan that broadcasts them on small data tells nothing about large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm.common import SPACES, materialize, plain

FIRST_DIGIT, WIDENING = 64, 8


def normalized(text: str | Column) -> Column:
    """The text with every run of white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), SPACES, " ")


def with_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``df`` with keep_id, group_size and kept.

    Rows are equal when their normalised texts are.  keep_id is the smallest ``doc_id`` among them
    (null only if all are null), group_size their number, kept true for exactly one row: that of
    keep_id, and of several such rows any one.  Null and empty texts equal each other.  An empty
    table gives an empty table; input columns named as the new ones give way.
    """
    df = plain(df, "keep_id", "group_size", "kept")
    body = normalized(text).cast("binary")
    digits = df.withColumn("__length", F.octet_length(body)).withColumn("__head", F.substring(body, 1, FIRST_DIGIT))
    groups = (digits.groupBy("__length", "__head").agg(F.count("*").alias("__n")).filter("__n > 1")
              .withColumn("__group", F.monotonically_increasing_id()))
    groups = materialize(groups, "radix-groups")  # group numbers hold from here on
    rows = digits.join(groups.drop("__n").hint("merge"), ["__length", "__head"], "left").drop("__head")
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "radix-rows")

    alone, twins = rows.filter("__group IS NULL"), rows.filter("__group IS NOT NULL")
    level = twins.select("__row", F.col(doc_id).alias("__id"), "__length", "__group", body.alias("__body"))
    done, offset = [], FIRST_DIGIT
    while True:
        done.append(level.filter(F.col("__length") <= offset)
                    .select("__row", "__id", "__group", F.lit(offset).alias("__level")))
        level = level.filter(F.col("__length") > offset)
        if level.isEmpty():
            break
        digit = F.col("__body").substr(F.lit(offset + 1), F.lit(offset * (WIDENING - 1)))
        level = level.withColumn("__digit", digit)
        split = (level.groupBy("__group", "__digit").agg(F.count("*").alias("__n"), F.min("__row").alias("__next"))
                 .filter("__n > 1"))
        level = materialize(level.join(split.hint("merge"), ["__group", "__digit"])
                            .select("__row", "__id", "__length", F.col("__next").alias("__group"), "__body"),
                            "radix-level")
        offset *= WIDENING

    key = ["__level", "__group"]
    ended = materialize(reduce(DataFrame.unionByName, done), "radix-ended")
    sizes = ended.groupBy(*key).agg(F.count("*").alias("group_size"), F.min("__id").alias("keep_id"))
    ended = ended.join(sizes, key)
    first = (ended.filter(F.col("__id").eqNullSafe(F.col("keep_id")))
             .groupBy(*key).agg(F.min("__row").alias("__kept")))
    ended = ended.join(first, key).select("__row", "keep_id", "group_size", (F.col("__row") == F.col("__kept")).alias("kept"))
    single = [F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    twins = twins.join(ended.hint("merge"), "__row", "left")  # a row that a later digit set apart is alone, too
    twins = twins.withColumns({"keep_id": F.when(F.col("kept").isNull(), F.col(doc_id)).otherwise(F.col("keep_id")),
                               "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
                               "kept": F.coalesce("kept", F.lit(True))})
    columns = [*df.columns, "keep_id", "group_size", "kept"]
    return alone.select(*df.columns, *single).unionByName(twins.select(*columns))
