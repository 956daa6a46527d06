"""Filter interaction audit: what each filter removes under every order of the filters.

Each document fails or passes each of five filters; its part, its 32 possible outcomes and its labels are all the
audit needs.  Spark counts documents per part and outcome; the counts of a part are reshaped to a 2x2x2x2x2 tensor,
and every figure of every step of every order is one contraction: along each axis a selector takes
pass, fail or all.

Whether a text was seen before is settled by counts, too.  Equal texts fail the other filters alike, so
documents are counted per text before texts meet, and a text that a third of all rows hold is a few rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelathe.llm.common import WORD

FILTERS = "ABCDE"
PASS, FAIL, ALL = np.array([[1, 0], [0, 1], [1, 1]], np.int64)
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> Column:
    """Bits 1 to 8 (filters A to D) of a text; null counts as empty.

    A: under 100 words; B: distinct words under 80 in 100; C: capitals A-Z over 10 in 100 code points; D: any of ``#$%&*|``."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    bits = [F.size(words) < 100,
            100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
            text.rlike("[#$%&*|]")]
    return sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))


def outcomes(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality",
             toxic: str = "toxic") -> DataFrame:
    """part, code (bits of failed filters), n, good, toxic: documents per part and outcome, and those labelled quality 1 and toxic 1."""
    marks = (labels.select(F.col(doc_id).alias("id"), F.col(quality).alias("q"), F.col(toxic).alias("t")).filter("id IS NOT NULL")
             .groupBy("id").agg(F.coalesce(F.max(F.col("q") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("t") == 1), F.lit(False)).alias("bad")))
    docs = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("part"), failures(F.col(text)).alias("code"),
                     F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("body"))
    docs = docs.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    # Per text and kind: how many documents, the smallest id (null: above all), and how many of that id.
    kind = ["body", "code", "part", "good", "bad"]
    ids = docs.withColumn("id", F.coalesce("id", F.lit(2**63 - 1))).groupBy(*kind, "id").agg(F.count("*").alias("c"))
    kinds = ids.groupBy(*kind).agg(F.sum("c").alias("n"), F.min(F.struct("id", "c")).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("body"))
    kinds = kinds.withColumn("kept", F.when(F.col("least.id") == first, F.col("least.c")).otherwise(0))
    rows = kinds.select("part", "good", "bad", F.explode(F.array(F.struct("code", F.col("kept").cast("long").alias("n")),
                                                                 F.struct((F.col("code") + 16).alias("code"), (F.col("n") - F.col("kept")).alias("n")))).alias("cell"))
    only = lambda c: F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0))
    return rows.groupBy("part", F.col("cell.code").alias("code")).agg(F.sum("cell.n").alias("n"), only("good").alias("good"), only("bad").alias("toxic"))


def selectors(order: tuple[int, ...], step: int, here: np.ndarray) -> np.ndarray:
    """One selector per axis: earlier filters pass, this one as ``here``, later ones all."""
    out = np.tile(ALL, (len(order), 1))
    out[list(order[:step])] = PASS
    out[order[step]] = here
    return out


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``tensor`` (2x2x2x2x2) contracted with each row of ``chosen`` (rows x 5 x 2)."""
    return np.einsum("abcde,na,nb,nc,nd,ne->n", tensor, *np.moveaxis(chosen, 1, 0), optimize=True)


def figures(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[dict]:
    """All steps of all orders, from the tensors of one part (axes in the order of ``FILTERS``)."""
    orders = list(permutations(range(len(FILTERS))))
    steps = [(o, k) for o in orders for k in range(len(o))]
    kept = contract(n, np.array([selectors(o, k, PASS) for o, k in steps]))
    gone = np.array([selectors(o, k, FAIL) for o, k in steps])
    removed = contract(n, gone)
    axis = np.array([o[k] for o, k in steps])
    alone = np.tile(ALL, (len(FILTERS), len(FILTERS), 1))
    single = np.tile(PASS, (len(FILTERS), len(FILTERS), 1))
    alone[range(len(FILTERS)), range(len(FILTERS))] = single[range(len(FILTERS)), range(len(FILTERS))] = FAIL
    values = {"kept": kept, "removed": removed, "redundant": contract(n, alone)[axis] - removed, "unique_fails": contract(n, single)[axis],
              "good_lost": contract(good, gone), "toxic_lost": contract(toxic, gone),
              "shapley": np.bincount(axis, removed, len(FILTERS)).astype(np.int64)[axis]}
    names = ["".join(FILTERS[i] for i in o) for o, _ in steps]
    return [{"filter_order": name, "step": k + 1} | {f: int(v[i]) for f, v in values.items()} for i, (name, (_, k)) in enumerate(zip(names, steps))]


def audit(df: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part (lang; null and '' are one part), order and step, zeros included.  Null texts are empty; null ids count as
    the largest, and are never labelled; of rows with one id and text none is the earlier; several labels of an id
    count as 1 if any is.  Other columns are not read.  A table without rows has no part, so it gives an empty table.
    shapley is a sum over all 120 orders; divided by that it is the filter's Shapley value."""
    cells = outcomes(df, labels, **columns)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("code", "n", "good", "toxic")).alias("cells"))  # at most 32

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (2,) * len(FILTERS)
        for batch in batches:
            for row in batch.to_pylist():
                tensors = {c: np.zeros(1 << len(FILTERS), np.int64) for c in ("n", "good", "toxic")}
                for cell in row["cells"]:
                    for c in tensors:
                        tensors[c][cell["code"]] += cell[c]
                # Bit k of the code is axis k: the last axis of a reshaped array is the lowest bit.
                rows = figures(*(t.reshape(shape).transpose() for t in tensors.values()))
                yield pa.RecordBatch.from_pylist([{"part": row["part"]} | r for r in rows], pa.schema(
                    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((f, pa.int64()) for f in FIGURES)]))

    return parts.mapInArrow(steps, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))

