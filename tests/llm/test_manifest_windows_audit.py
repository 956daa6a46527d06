"""Merkle manifest, repeated windows and filter audit against plain versions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tests.llm import brute
from tracelathe.llm import filter_audit, merkle, queries, windows
from tracelathe.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(seed: int = 4) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, shared passages."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma,", "naïve", "日本", "x&y", "ZZZ"]) + str(rnd.randrange(40))
    passage = [word() for _ in range(60)]
    out = [(None, None, None, None, None), (None, "a text without id", "en", "s", 3), (5, None, "en", None, None), (6, "", "en", "s", 0),
           (7, " \n\t ", None, "s", 4), (8, "z " * 3000, "de", "s", 6000), (9, "\x1c" * 30 + " one", "de", "s", 1), (7, "same id", "fr", "s", 7)]
    out += [(100 + k, " ".join(passage[k % 7:50 + k % 9] + [word() for _ in range(rnd.randrange(90))]), rnd.choice(["en", "de", None, ""]), "s", k) for k in range(40)]
    out += [out[-1]] * 3 + [(None, out[-1][1], "en", "s", 1), (300, out[-1][1], "en", "s", 1), (3, "\t".join(passage * 40), "en", "s", 9)]
    out += [(400 + k, "exactly the same text of a large group " * 4, "en", "hot", 1) for k in range(60)]
    rnd.shuffle(out)
    return out


ROWS = rows_of()


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, SCHEMA).repartition(7), "corner-rows")  # rows in a fixed order


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest --------------------------------------------------------------------------------

def manifest_rows(df, bad, **options):
    out = merkle.audit(df, F.col("doc_id").isin(*bad), **options)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified").collect()), key=key)


@pytest.mark.parametrize("arity,levels", [(2, 10), (2, 1), (3, 2)])
def test_manifest(docs, arity, levels):
    bad = {5, 6, 103, 117, 8}
    want = sorted(brute.merkle(ROWS, bad, arity), key=key)
    got = manifest_rows(docs, bad, arity=arity, levels=levels)
    # Equal leaves of a tree are interchangeable: their proofs are compared as a set.
    assert [r[:4] for r in got] == [r[:4] for r in want] and got == want
    assert all(r[6] for r in got if r[0] == 5) and not any(r[6] for r in got if r[0] in (6, 103, 117, 8))


def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bad = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0}
    got = queries.op11_merkle(spark, TINY).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect())) == sorted(brute.merkle(rows, bad))


def test_manifest_of_few_rows(docs, empty):
    assert merkle.audit(empty, F.lit(True)).count() == 0
    one = merkle.audit(docs.filter("doc_id = 6"), F.lit(False)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == [] and one["verified"]


def test_proofs_of_some_leaves(docs):
    leaves = docs.select(merkle.tree_of(F.col("lang")).alias("tree"), "doc_id", merkle.leaf(*[F.col(c) for c in ("doc_id", "text")]).alias("leaf"))
    manifest = merkle.build(leaves, levels=2)
    some = {(r["tree"], r["rank"]): r for r in merkle.proofs(manifest, manifest.leaves.filter("doc_id % 3 = 0")).collect()}
    every = {(r["tree"], r["rank"]): r for r in merkle.proofs(manifest).collect()}
    assert some and all(every[k] == r for k, r in some.items()) and {r["doc_id"] % 3 for r in some.values()} == {0}


def test_segments_hold_the_records_of_their_roots(docs):
    leaves = docs.select(F.lit("=x").alias("tree"), "doc_id", merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf"))
    manifest = merkle.build(leaves, levels=3)
    assert len(manifest.trees) == 3  # 116 leaves: 7 levels
    for tier in manifest.trees:
        for row in tier.collect():
            records = {r["digest"]: r["children"] for r in row["records"]}
            assert row["root"] in records and all(d == sha("".join(c)) for d, c in records.items())


# --- windows ---------------------------------------------------------------------------------

def window_rows(df, length, **options):
    out = windows.without_repeated_windows(df, length, **options).select("doc_id", "n_words", "removed", "kept").collect()
    return sorted(((r[0], r[1], [(s["start"], s["end"]) for s in r[2]], r[3]) for r in out), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


@pytest.mark.parametrize("length,options", [(13, {}), (1, {}), (13, {"block_windows": 50}), (3, {"block_windows": 700, "least_bits": 0}), (13, {"bucket_bytes": 100})])
def test_windows(docs, length, options):
    want = brute.windows([(d, t) for d, t, *_ in ROWS], length)
    assert window_rows(docs, length, **options) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


def test_windows_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, sum(b - a for a, b in spans), sha(kept)) for d, n, spans, kept in brute.windows(rows, 13)]
    assert sorted(map(tuple, queries.op12_windows(spark, TINY).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(want)


def test_hashes_of_windows_are_those_of_their_words():
    import pyarrow as pa
    words, borders = windows.words_of(pa.array([" a b  a", None, "", "b\x0ba c\x1cd "]))
    assert borders.tolist() == [0, 3, 3, 3, 6] and len(set(words.tolist())) == 3 and words[0] == words[2] == words[4]
    import numpy as np
    many = np.random.default_rng(1).integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x123456789ABCDEF1)
    roll = windows.Roller(5)
    seen = {}
    for i, h in enumerate(roll(many).tolist()):
        assert seen.setdefault(h, tuple(many[i:i + 5])) == tuple(many[i:i + 5])
    assert len(seen) == 3 ** 5 and roll(many[:4]).tolist() == []


# --- audit -----------------------------------------------------------------------------------

FIGURES = ["part", "filter_order", "step", *filter_audit.FIGURES]


def test_audit(spark, docs):
    labels = [(d, q, t) for d, q, t in [(5, 1, 0), (8, 0, 1), (100, 1, 1), (100, 0, None), (101, None, 1), (None, 1, 1), (402, 1, 1), (105, 1, 0), (9999, 1, 1)]]
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(*FIGURES).collect())) == sorted(brute.audit([r[:3] for r in ROWS], [x for x in labels if x[0] is not None]))


def test_audit_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{TINY}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, queries.op13_filter_audit(spark, TINY).select(*FIGURES).collect())) == sorted(brute.audit(rows, labels))


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# --- handling --------------------------------------------------------------------------------

def test_clashing_columns_and_empty_tables(spark, docs, empty):
    names = ["tree", "leaf", "rank", "n", "root", "path", "id", "digest", "removed", "kept", "n_words", "block", "bucket", "code", "part", "good", "body", "start", "end", "label"]
    clash = docs.withColumns({n: F.lit(7.0) for n in names})
    assert manifest_rows(clash, {6}) == manifest_rows(docs, {6})
    assert window_rows(clash, 13) == window_rows(docs, 13)
    out = windows.without_repeated_windows(clash, 13)
    assert set(out.columns) == set(clash.columns) and out.select("digest", "start").distinct().collect() == [(7.0, 7.0)]
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").withColumns({n: F.lit(1) for n in names})
    plain = filter_audit.audit(docs, labels.select("doc_id", "quality", "toxic"))
    assert sorted(map(tuple, filter_audit.audit(clash, labels).collect())) == sorted(map(tuple, plain.collect()))
    assert windows.without_repeated_windows(empty).count() == 0
