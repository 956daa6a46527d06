"""A training-data pipeline over ``documents``: language, exact copies, near copies, mix, tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept.
``run`` writes every stage's result to the shared folder and reads it again, so a lost executor
costs at most one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelathe.llm import exact_dedup, langid, minhash, mixing, pieces
from tracelathe.llm.common import delete, documents, held_out, materialize, with_written_order

PIECES = "piece_bpe_32k.model"
#: A document whose best language has a smaller posterior is rejected, as is one without letters.
LEAST_SCORE = 0.5


def _kept(docs: DataFrame, made: tuple[str, ...], choose) -> DataFrame:
    """The rows that ``choose`` keeps, with the columns of ``docs`` as they were: those named as the ones that
    the operator makes are set aside meanwhile."""
    aside = {c: f"__aside_{c}" for c in docs.columns if c.lower() in made}
    return choose(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognised language; learned from the labelled three quarters of the input.

    Null and empty texts, and texts without letters, go; repeated rows go or stay together; rows of a null id teach
    nothing; an empty table gives an empty table."""
    found = lambda df: langid.with_language(df, df.filter(~held_out("doc_id")), public_tokenizers.path(PIECES))
    return _kept(docs, ("lang_pred", "score"), lambda df: found(df).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the smallest id, one row of it.  Null and empty texts are one group."""
    return _kept(docs, ("keep_id", "group_size", "kept"), lambda df: exact_dedup.with_duplicates(df).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 over shingles of five words.  Texts without words
    are no copies of each other; repeated rows are."""
    return minhash.without_near_duplicates(docs, size=5, share=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come near their target weights, in the order of the schedule.
    Documents without words go; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of every row of the mix, in its order.  Null texts are empty."""
    out = pieces.with_pieces(with_written_order(docs, "at"), public_tokenizers.path(PIECES))
    out = out.select("at", "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
    # Stored before it is sorted, which reads it twice.
    return materialize(out, "encoded").orderBy("at").drop("at")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("encode", encode)]

#: SQL can express neither the trained language model nor the encoding; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, in the order of the mix."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:  # no later stage reads it
            delete(before)
    return with_written_order(docs, "at").orderBy("at").drop("at")
