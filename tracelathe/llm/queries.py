"""The registered queries of the thirteen operators: each applies its operator to the whole table and
derives the contract's columns from the operator's real output."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelathe.llm import (exact_dedup, filter_audit, langid, merkle, minhash, mixing, pieces, quality, repeats, simhash, token_counts,
                            token_store, windows)
from tracelathe.llm.common import documents, held_out, materialize, shared_dir
from tracelathe.llm.sql import ORACLE_SQL  # noqa: F401


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_groups(documents(spark, sf_dir, "doc_id", "text"), size=3, share=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns n_within: for ids divisible by 20, how many documents lie within 3 bits."""
    out = materialize(simhash.edited_likeness(documents(spark, sf_dir, "doc_id", "text")), "fingerprints")
    asked = F.col("doc_id") % 20 == 0
    counts = simhash.count_within(out, out.filter(asked))
    out = out.join(counts.hint("merge"), "fingerprint", "left").withColumn("n_within", F.when(asked, F.col("n_within")))
    return out.withColumns({c: simhash.as_hex(c) for c in ("fingerprint", "edited_fingerprint")})


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.with_pieces(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out("doc_id"))
    model = quality.learn(docs, labels)
    return quality.with_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = langid.with_language(docs.select("doc_id", "text"), docs.filter(~held_out("doc_id")), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.with_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2(exact_dedup.normalized("text"), 256).alias("text_sha256"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept_bytes")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.with_token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    out = merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.without_repeated_windows(documents(spark, sf_dir, "doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {q.__name__: q for q in (op1_minhash, op2_mixing, op3_simhash, op4_pieces, op5_quality, op6_langid, op7_exact_dedup,
                                   op8_token_counts, op9_repeats, op10_token_store, op11_merkle, op12_windows, op13_filter_audit)}
