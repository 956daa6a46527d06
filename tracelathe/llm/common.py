"""What several operators share: tables in the shared folder, slices by bytes, unit caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelathe.session import materialize, shared_dir

__all__ = ["UnitCache", "by_bytes", "delete", "documents", "held_out", "longs", "materialize", "plain",
           "shared_dir", "with_written_order", "small_batches", "texts_of"]

#: The separators of words, and the class of all other characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def small_batches(df: DataFrame, limit: int = 1 << 23) -> DataFrame:
    """Arrow batches for Python hold at most ``limit`` bytes (or one row), however long the texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > limit:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    return df


def plain(df: DataFrame, *made: str) -> DataFrame:
    """``df`` without the columns an operator is about to make: a clashing input column gives way."""
    return df.drop(*made)


def with_written_order(df: DataFrame, name: str) -> DataFrame:
    """A table read from files, with a column ``name`` by which its rows sort as they were written."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")  # as a number: names of five and six digits don't sort
    return df.withColumn(name, F.struct(part.alias("part"), "_metadata.file_name", "_metadata.row_index"))


def texts_of(column: pa.Array) -> list[str]:
    """Null texts count as empty."""
    return [t or "" for t in column.to_pylist()]


def by_bytes(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of a text column of about ``limit`` bytes each; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for a, b in zip(cuts, [*cuts[1:], len(column)]):
        yield column.slice(a, b - a)


class UnitCache:
    """Results per distinct unit of text.  Between slices at most ``limit`` units are kept, so that
    memory stays bounded; a forgotten unit is solved again, with the same result."""

    def __init__(self, solve: Callable[[list[str]], Iterable], limit: int = 250_000):
        self.solve, self.limit, self.known = solve, limit, {}

    def ready(self, units: list[str]) -> dict:
        if len(self.known) > self.limit:
            self.known.clear()
        new = [u for u in set(units) if u not in self.known]
        if new:
            self.known.update(zip(new, self.solve(new)))
        return self.known


def longs(parts: list[np.ndarray]) -> pa.Array:
    """One list of 64-bit integers per array."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def delete(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: Column | str) -> Column:
    """The quarter of documents that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2
