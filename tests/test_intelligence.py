"""Terms, clusters, forests, evidence, embeddings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelathe.operators import embed, evidence, forest, parse, registers, text, triage
from tracelathe.operators.cluster import density_clusters
from tracelathe.schema import PIECE


def test_term_scores_match_formula(access_of, lines_of):
    names = ["core alpha", "core alpha", "core beta", "Other.core"]
    access = access_of([("t", i, "R", d, 1) for i, d in enumerate(names)])
    frame = parse.analysis_frame(access, parse.parse_fsm(lines_of("none")))
    got = {r.term: r.score for r in text.term_scores(text.described(frame)).collect()}
    docs = [re.findall(r"\w\w+", n.lower()) for n in names]
    stop = {"other"} & set(text.stop_words(access.sparkSession))
    grams = [[" ".join(d[i:i + n]) for d in [[w for w in doc if w not in stop]] for n in (1, 2, 3)
              for i in range(len(d) - n + 1)] for doc in docs]
    df = {t: sum(t in g for g in grams) for t in {t for g in grams for t in g}}
    want = dict.fromkeys(df, 0.0)
    for g in grams:
        w = {t: g.count(t) * (math.log(5 / (1 + df[t])) + 1) for t in set(g)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            want[t] += v / norm
    assert got == pytest.approx(want)
    best = {r.descr: r for r in text.top_registers(frame).collect()}
    assert best["core alpha"].term in ("core", "core alpha", "alpha") and best["core alpha"].address == "0x0"


def test_terms_are_matched_case_sensitively(access_of, lines_of):
    access = access_of([("t", i, "R", d, 1) for i, d in enumerate(["UPPER.REG", "lower.reg"])])
    frame = parse.analysis_frame(access, parse.parse_fsm(lines_of("none")))
    assert {r.descr for r in text.top_registers(frame).collect()} == {"lower.reg"}


def _brute_clusters(pts, eps, min_points):
    n = len(pts)
    near = [[j for j in range(n) if math.dist(pts[i], pts[j]) <= eps] for i in range(n)]
    core = [len(near[i]) >= min_points for i in range(n)]
    label, next_id = [None] * n, 0
    for i in range(n):
        if not core[i] or label[i] is not None:
            continue
        stack, label[i] = [i], next_id
        while stack:
            for j in near[stack.pop()]:
                if label[j] is None:
                    label[j] = next_id
                    if core[j]:
                        stack.append(j)
        next_id += 1
    return label


@pytest.mark.parametrize("seed,spread", [(1, 0.3), (2, 0.8), (3, 0.05)])
def test_clusters_equal_brute_force(spark, seed, spread):
    rnd = random.Random(seed)
    pts = []
    for _ in range(6):
        c = [rnd.uniform(-2, 2) for _ in range(3)]
        pts += [[rnd.gauss(x, spread) for x in c] for _ in range(20)]
    pts += [pts[0]] * 8 + [[rnd.uniform(-4, 4) for _ in range(3)] for _ in range(30)]
    pts += [[i * 0.4, 9.0, 9.0] for i in range(12) for _ in range(3)]  # a chain of dense sites
    rnd.shuffle(pts)
    df = spark.createDataFrame([("t", f"p{i}", i, *p) for i, p in enumerate(pts)],
                               "test_id string, descr string, first_at long, x double, y double, z double")
    got = {r.first_at: r.cluster_id for r in density_clusters(df, ["x", "y", "z"]).collect()}
    want = {i: c for i, c in enumerate(_brute_clusters(pts, 0.5, 5)) if c is not None}
    assert got == want and len(set(want.values())) > 1


def test_no_clusters(spark):
    df = spark.createDataFrame([("t", f"p{i}", i, float(i * 10)) for i in range(6)],
                               "test_id string, descr string, first_at long, x double")
    assert density_clusters(df, ["x"]).count() == 0


def _planted(spark, n, outliers):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    x[:outliers] += 12
    return spark.createDataFrame([("t", f"r{i:05d}", *map(float, v)) for i, v in enumerate(x)],
                                 "test_id string, descr string, a double, b double, c double")


@pytest.mark.parametrize("n", [100, 1000])
def test_forest_finds_planted_outliers(spark, n):
    df = _planted(spark, n, 4)
    flags = forest.flag_anomalies(df, ["test_id"], ["descr"], ["a", "b", "c"]).orderBy(F.desc("confidence")).collect()
    assert {r.descr for r in flags[:4]} == {f"r{i:05d}" for i in range(4)}
    assert len(flags) == math.ceil(0.05 * (n - 1)) and all(r.confidence > 0 for r in flags)
    again = forest.flag_anomalies(df.repartition(3), ["test_id"], ["descr"], ["a", "b", "c"]).collect()
    assert {(r.descr, r.confidence) for r in again} == {(r.descr, r.confidence) for r in flags}


def test_forest_scores_do_not_depend_on_salts(spark, monkeypatch):
    df = _planted(spark, 300, 3)
    trees = forest.isolation_forest(df, ["test_id"], ["descr"], ["a", "b", "c"], n_trees=20)
    one = {r.descr: r.score for r in forest.forest_scores(df, trees, ["test_id"], ["descr"], ["a", "b", "c"]).collect()}
    monkeypatch.setattr(forest, "_SCORE_ROWS", 50)
    many = {r.descr: r.score for r in forest.forest_scores(df, trees, ["test_id"], ["descr"], ["a", "b", "c"]).collect()}
    assert one == many and len(one) == 300
    nodes = forest.forest_nodes(trees, ["test_id"])
    assert nodes.where("node = 1").agg(F.sum("size")).first()[0] == 20 * 256


def test_path_norm():
    assert forest.path_norm([1, 2]).tolist() == [0.0, 1.0]
    assert float(forest.path_norm(256)) == pytest.approx(10.2447, abs=1e-3)


DOCS = [["a.b[3]", "c.d"], ["plain", "x y", "z"], ["p", "a.b", "q", "r", "c[1]x", "[2]", "tail"], ["End.", ".start"], ["one"]]


def test_path_pieces_equal_joined_text(access_of):
    rows = [(f"t{i}", j, "R", d, 1) for i, doc in enumerate(DOCS) for j, d in enumerate(doc)]
    for chunk in (1, 2, None):
        got = {}
        for r in embed.path_pieces(access_of(rows), chunk).orderBy("test_id", "line_id", "pos", "k").collect():
            got.setdefault(r.test_id, []).append(r.piece)
        assert got == {f"t{i}": re.findall(PIECE, " ".join(doc).lower()) for i, doc in enumerate(DOCS)}


def test_weights_are_unit_length_and_embedding_shapes(access_of):
    rows = [(f"t{i}", j, "R", f"u{(i * j) % 5}.r[{j % 4}]", 1) for i in range(6) for j in range(12)]
    access = access_of(rows)
    norms = embed.run_tfidf(access).groupBy("test_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 6 and all(r.n == pytest.approx(1.0) for r in norms)
    out, fit, vocab = embed.run_embeddings(access)
    rows = out.collect()
    assert fit is not None and vocab.count() > 10 and {r.embedding_size for r in rows} == {6}
    assert np.abs(np.mean([r.embedding for r in rows], axis=0)).max() < 1e-9
    few, none, _ = embed.run_embeddings(access_of([("t", 0, "R", "x.y", 1), ("u", 0, "R", "x", 1)]))
    assert none is None and {r.embedding_size for r in few.collect()} == {3}


def test_projection_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 12)) * np.arange(1, 13)
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i int, v array<double>")
    out, _ = embed.project(df, "v", 3)
    got = np.array([r.embedding for r in out.orderBy("i").collect()])
    c = x - x.mean(axis=0)
    vt = np.linalg.svd(c, full_matrices=False)[2][:3]
    vt = vt * np.sign(vt[np.arange(3), np.abs(vt).argmax(axis=1)])[:, None]
    assert np.allclose(got, c @ vt.T)


def test_evidence_order_and_tags(spark, access_of):
    top = spark.createDataFrame([("t", "a", "term", 2.0, 1)], "test_id string, descr string, term string, score double, rank int")
    clusters = spark.createDataFrame([("t", d, i, 0) for i, d in enumerate("ab")], "test_id string, descr string, first_at long, cluster_id int")
    seqs = spark.createDataFrame([("t", "a->b->c", 5, 1), ("t", "c->d->d", 3, 2)], "test_id string, sequence string, n long, rank int")
    got = {r.descr: (r.importance, r.source) for r in evidence.register_importance(top, clusters, seqs).collect()}
    assert got == {"a": (2.0, "terms"), "b": (0.7, "cluster"), "c": (0.5, "sequence"), "d": (0.3, "sequence")}
    access = access_of([("t", 1, "R", "a", 1), ("t", 2, "R", "zz", 1)])
    tagged = evidence.tag_importance(access, evidence.register_importance(top, clusters, seqs))
    assert {r.descr: r.ai_importance for r in tagged.collect()} == {"a": 2.0, "zz": None}


def test_cluster_evidence_takes_first_twenty(spark):
    top = spark.createDataFrame([], "test_id string, descr string, term string, score double, rank int")
    clusters = spark.createDataFrame([("t", f"r{i:02d}", i, 0) for i in range(30)], "test_id string, descr string, first_at long, cluster_id int")
    seqs = spark.createDataFrame([], "test_id string, sequence string, n long, rank int")
    assert {r.descr for r in evidence.register_importance(top, clusters, seqs).collect()} == {f"r{i:02d}" for i in range(20)}


def test_line_ids_of_late_partitions(spark, access_of):
    """Ids as Spark gives them in input partition 5000."""
    from tracelathe.operators import access_patterns
    access = access_of([("t", 10 * i, "RW"[i % 2], f"u.r[{i % 4}]", i) for i in range(40)])
    far = access.withColumn("line_id", F.col("line_id") + F.lit(5000 << 33))
    shown = lambda df: sorted(map(str, df.collect()))
    for build in (access_patterns.interval_stats, lambda a: registers.access_vectors(a).drop("first_at")):
        assert shown(build(access)) == shown(build(far))
    fsm = parse.parse_fsm(spark.createDataFrame([("t", 5000 << 33, "[5] FSM a: X -> Y")], "test_id string, line_id long, raw string"))
    frame = parse.analysis_frame(far, fsm)
    found = evidence.extract_intelligence(far, frame)
    assert found["register_importance"].count() > 0


def test_report_holds_all_runs_of_a_bucket(spark):
    runs = spark.createDataFrame([(f"f{k}", "FAIL") for k in range(3)], "test_id string, status string")
    rows = [(f"f{k}", "temporal_patterns", "", f"x{j:02d}", 1.0, 0.0, 1.0, 0.0, 0.0, float(j + 10 * k + 4), True) for k in range(3) for j in range(15)]
    dev = spark.createDataFrame(rows, "test_id string, family string, entity string, feature string, value double, mean double, std double, p05 double, p95 double, z double, outside boolean")
    err = spark.createDataFrame([], "test_id string, ts_ns long, line_id long, pos int, message string")
    signed = triage.signatures(runs, err, dev)
    report = triage.triage_report(triage.failure_buckets(signed), signed, dev).orderBy("rank").collect()
    assert [r["rank"] for r in report] == list(range(1, 46)) and {r["test_id"] for r in report} == {"f0", "f1", "f2"}
    assert [abs(r["z"]) for r in report] == sorted((abs(r["z"]) for r in report), reverse=True)
    assert triage.triage_report(triage.failure_buckets(signed), signed, dev, k=5).count() == 5


def test_values_off_a_constant_are_reported_first(spark):
    """All passing runs share a value: there is no z, and the deviation is the strongest evidence."""
    rows = [(f"p{k}", "PASS", "register_values", e, "max", v) for k in range(3) for e, v in (("fixed", 1.0), ("other", 2.0), ("varies", float(k)))]
    rows += [("f", "FAIL", "register_values", e, "max", v) for e, v in (("fixed", 9.0), ("other", 2.0), ("varies", 50.0))] + [("g", "FAIL", "register_values", "fixed", "max", 4.0)]
    features = spark.createDataFrame(rows, "test_id string, status string, family string, entity string, feature string, value double")
    dev = triage.deviations(features, triage.learn_baseline(features))
    assert sorted((r.test_id, r.entity, r.z is None) for r in dev.collect()) == [("f", "fixed", True), ("f", "varies", False), ("g", "fixed", True)]
    runs = features.select("test_id", "status").distinct()
    signed = triage.signatures(runs, spark.createDataFrame([], "test_id string, ts_ns long, line_id long, pos int, message string"), dev)
    assert {(r.test_id, r.register) for r in signed.collect()} == {("f", "fixed"), ("g", "fixed")}
    report = triage.triage_report(triage.failure_buckets(signed), signed, dev).orderBy("rank").collect()
    assert [(r["test_id"], r["entity"], r["value"]) for r in report] == [("f", "fixed", 9.0), ("g", "fixed", 4.0), ("f", "varies", 50.0)]


def _plain_vocabulary(texts, cap):
    counts = Counter()
    for words in texts:
        for size in (1, 2, 3):
            counts.update(" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
    return sorted(counts, key=lambda t: (-counts[t], t))[:cap]


@pytest.mark.parametrize("cap, broadcast", [(4, None), (9, None), (9, 0), (60, None)])
def test_vocabulary_pruned_by_word_counts(spark, monkeypatch, cap, broadcast):
    """Frequent grams, ties at the floor, a word repeated side by side, empty and null texts; too few words, too many to broadcast."""
    if broadcast is not None:
        monkeypatch.setattr(text, "BROADCAST_WORDS", broadcast)
    draw = random.Random(5)
    texts = [draw.choices(["alpha", "beta", "gamma", "delta", "kappa", *(f"rare{i}" for i in range(12))],
                          weights=[9, 7, 5, 5, 5] + [1] * 12, k=draw.randrange(12)) for _ in range(30)] + [["alpha"] * 9]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    got = text.document_tfidf(spark.createDataFrame(rows, "id long, body string"), "id", "body", cap)
    assert {r.term for r in got.collect()} == set(_plain_vocabulary(texts, cap))


def test_frequent_words_keep_ties(spark):
    words = spark.createDataFrame([("aa", 9), ("bb", 5), ("cc", 5), ("dd", 4)], "term string, n long")
    assert {r.term for r in text.frequent_words(words, 2).collect()} == {"aa", "bb", "cc"}
    assert text.frequent_words(words, 5) is None


def test_corpus_clusters_join_runs(access_of):
    """Registers of two runs at the same places, alike over both; neither run alone holds five neighbours."""
    def run(name):
        rows = [(name, 1000 * k, "R", f"core.r{i}", 7) for k in range(4) for i in range(3)]
        return access_of(rows + [(name, 90_000 * k, "W", "core.odd" + name, 10 ** 6 * k) for k in range(9) if name == "a"])
    access = run("a").unionByName(run("b"))
    got = {(r.test_id, r.descr, r.cluster_id) for r in evidence.corpus_clusters(access).collect()}
    assert got == {(t, f"core.r{i}", 0) for t in "ab" for i in range(3)}
    assert not evidence.access_clusters(access).count()
