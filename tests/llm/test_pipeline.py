"""The pipeline, stage by stage, against plain versions of its stages."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.conftest import TINY
from tests.llm import brute
from tracelathe.llm import langid, mixing
from tracelathe.llm.common import documents, held_out, materialize


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    columns = documents(spark, TINY).columns
    whole = documents(spark, TINY)
    extra = whole.limit(1).selectExpr("CAST(-1 AS BIGINT) AS doc_id", "'12 34 !!' AS text", "lang", "source", "n_chars")
    docs = materialize(whole.unionByName(extra), "test-input")

    stages = dict(corpus_pipeline.STAGES)
    kept = materialize(stages["language"](spark, docs, TINY), "test")
    best = langid.with_language(docs, docs.filter(~held_out("doc_id")), public_tokenizers.path(corpus_pipeline.PIECES)).collect()
    assert ids(kept) == sorted(r["doc_id"] for r in best if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE)
    assert -1 not in ids(kept) and len(ids(kept)) >= 0.95 * whole.count()

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    once = materialize(stages["exact_dedup"](spark, kept, TINY), "test")
    assert ids(once) == sorted(r[0] for r in brute.exact(rows) if r[3])

    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    apart = materialize(stages["near_dedup"](spark, once, TINY), "test")
    assert ids(apart) == sorted(r[0] for r in brute.near_components(rows, 5, 80) if r[3])

    mixed = materialize(stages["mixing"](spark, apart, TINY), "test")
    plan = mixing.mix(apart).collect()
    wanted = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in plan if r["size"]}
    assert Counter(ids(mixed)) == Counter({d: n for d, n in wanted.items() if n})
    assert all(df.columns == columns for df in (kept, once, apart, mixed))

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    out = sorted(tuple(r) for r in stages["encode"](spark, mixed, TINY).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded = [(r["doc_id"], model.encode(r["text"])) for r in mixed.collect()]
    assert out == sorted((d, len(i), sha(",".join(map(str, i))), sha(model.decode(i))) for d, i in encoded)


def test_run(spark):
    out = corpus_pipeline.run(spark, TINY)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_empty_input(spark):
    docs = documents(spark, TINY).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, TINY), "test")
    assert docs.count() == 0


def test_rows_come_in_the_order_of_the_mix(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(documents(spark, TINY), "test")
    mixed = stages["mixing"](spark, docs, TINY)
    wanted = [r["doc_id"] for r in mixed.collect()]
    assert wanted == [r["doc_id"] for r in mixing.mixed_documents(docs.repartition(3)).collect()]
    starts = {}
    for r in mixing.interleaved(docs).filter("begin = 0").collect():
        starts.setdefault(r["doc_id"], []).append((r["slot"], r["at"]))
    copies = [(sorted(starts[d])[k], d) for d, n in Counter(wanted).items() for k in range(n)]
    assert wanted == [d for _, d in sorted(copies)]
    assert wanted == [r["doc_id"] for r in stages["encode"](spark, materialize(mixed, "test"), TINY).collect()]


def test_repeated_rows_and_sources_in_the_mix(spark):
    """Every row comes as often as ``mix`` takes it, rows equal in id, source and text too, and keeps its own columns."""
    rows = [(k % 40, f"word{k % 40} " * (30 + k % 40), f"s{k % 3}" if k % 4 else None, k, f"extra{k}") for k in range(120)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string, size long, slot string"), "test")
    wanted = Counter()
    for r in mixing.mix(docs, block=8).collect():
        wanted[r["doc_id"], r["source"]] += int(r["taken"] / r["size"] + 0.5)
    for part_words in (200, 10**7):
        out = materialize(mixing.mixed_documents(docs, block=8, part_words=part_words), "test").collect()
        assert Counter((r["doc_id"], r["source"]) for r in out) == +wanted
        assert {tuple(r) for r in out} <= set(rows)


def test_stages_keep_columns_of_any_name(spark):
    docs = documents(spark, TINY).limit(60)
    names = ["lang_pred", "score", "keep_id", "group_size", "kept", "digest", "label", "text_key", "size", "slot", "place", "target", "taken",
             "group", "component_id", "n_shingles", "set_key", "no", "at", "part"]
    docs = materialize(docs.selectExpr("*", *[f"doc_id * {7 + k} AS {n}" for k, n in enumerate(names)]), "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == r["doc_id"] * (7 + k) for r in got for k, n in enumerate(names)), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert out.count() == 60


def test_stages_with_nulls_and_repeats(spark):
    schema = documents(spark, TINY).schema
    some = [tuple(r) for r in documents(spark, TINY).limit(20).collect()]
    rows = some + [(None, *some[0][1:]), (None, None, None, None, None), (900, None, "en", None, 0), (901, "", None, "s", 0), some[1], some[1]]
    docs = materialize(spark.createDataFrame(rows, schema), "test")
    stages = dict(corpus_pipeline.STAGES)
    language = materialize(stages["language"](spark, docs, TINY), "test")
    assert {900, 901} & set(r["doc_id"] for r in language.collect()) == set() and language.filter("text IS NULL").count() == 0
    exact = stages["exact_dedup"](spark, docs, TINY)
    assert exact.count() == len({brute.re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})
    near = stages["near_dedup"](spark, docs, TINY)
    assert near.filter("text IS NULL OR text = ''").count() == 3
    assert stages["mixing"](spark, docs, TINY).filter("text IS NULL").count() == 0
    assert stages["encode"](spark, docs, TINY).count() == len(rows)
