"""Token counts: batch encoding in Arrow functions that return lengths only.

Slices are balanced by bytes, not rows; long texts are cut at safe boundaries (``token_units``),
so no text is encoded as one huge string and none is truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelathe.llm import token_units
from tracelathe.llm.byte_units import words_with_space
from tracelathe.llm.common import by_bytes, plain, small_batches, texts_of


def count_tokens(text: Column, path: str, slice_bytes: int = 1 << 21) -> Column:
    """Tokens of each text under the tokenizer file ``path`` (BIGINT); null counts as empty: 0.

    Strings of special tokens inside a text count as the library counts them by default.
    """
    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = token_units.encoder(path, words_with_space)
        for batch in batches:
            parts = [encoder.counts(texts_of(part)) for part in by_bytes(batch, slice_bytes)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return lengths(text)


def with_token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Null and empty texts: 0, 0, false.  Every row is kept, repeated ones too; an empty table gives
    an empty table; input columns named as the new ones give way to them.
    """
    return (plain(small_batches(df), "n_bytes", "n_tokens", "over_limit")
            .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("n_tokens", count_tokens(F.col(text), path))
            .withColumn("over_limit", F.col("n_tokens") > limit))
