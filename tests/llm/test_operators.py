"""The operators against plain versions, on made-up corner cases and on the given small tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.conftest import TINY
from tests.llm import brute
from tracelathe.llm import byte_units, components, exact_dedup, langid, minhash, mixing, pieces, quality, queries, repeats, simhash, token_counts, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def letters(rnd, n):
    return "".join(rnd.choice("abcdefghij ") for _ in range(n))


def corner_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rnd = random.Random(5)
    base = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rnd.randrange(50)) for _ in range(150)]
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "One"), (6, "one two"), (7, " ".join(base)), (8, "  ".join(base)),
            (9, " ".join(base)), (9, " ".join(base)), (10, "x" * 70_000), (11, "x" * 70_000), (12, "x" * 70_000 + "y"),
            (13, "naïve café 日本語 🙂 " * 300), (14, "\ttab\x0bvt\x0cff\r\n"), (15, " lead"), (16, "lead "), (17, "Ä" * 500), (18, "<|endoftext|> a <s>")]
    for k in range(40):
        w = list(base)
        for _ in range(k % 7):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, letters(rnd, rnd.randrange(1, 2000))) for k in range(30)]
    shared = letters(rnd, 700)
    rows += [(300 + k, letters(rnd, rnd.randrange(0, 300)) + shared[k * 5:650 - k * 7] + letters(rnd, 50)) for k in range(12)]
    rows += [(320, "abcabcabc" * 200), (321, letters(rnd, 399)), (322, shared[:400]), (323, shared[:399] + "#")]
    return rows


CORNERS = corner_rows()


@pytest.fixture(scope="module")
def corners(spark):
    rows = [(d, t, "en" if d % 2 else None, None if d % 5 == 0 else f"s{d % 3}", len(t or "")) for d, t in CORNERS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tiny_rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def digest(s: bytes) -> str:
    return hashlib.sha256(s).hexdigest()


# --- near and exact copies -------------------------------------------------------------------

@pytest.mark.parametrize("block", [1024, 8])
def test_near_groups(corners, block):
    got = minhash.near_groups(corners, size=3, share=85, block=block)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_components(CORNERS, 3, 85))


def test_near_groups_of_the_table(spark, tiny_rows):
    assert rows_of(queries.op1_minhash(spark, TINY), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_components(tiny_rows, 3, 85))


def test_near_copies_whose_hub_is_not_linked(spark):
    """Copies differ from the original by up to three words and from each other by up to six."""
    rnd, base = random.Random(3), [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(120)] = f"n{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size=3, share=85, block=16)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_components(rows, 3, 85))


def test_without_near_duplicates(corners, empty):
    kept = minhash.without_near_duplicates(corners, size=3, share=85)
    assert kept.columns == corners.columns
    wanted = sorted({r[0] for r in brute.near_components(CORNERS, 3, 85) if r[3]})
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted
    assert minhash.without_near_duplicates(empty).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rnd.randrange(60), 1000 + rnd.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    import sys
    sys.setrecursionlimit(5000)
    for a, b in edges:
        parent[find(a)] = find(b)
    groups, mine = {}, {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    for r in got:
        mine.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_exact_duplicates(corners, empty):
    out = exact_dedup.with_duplicates(corners)
    got = rows_of(out, "doc_id", "keep_id", "group_size")
    assert got == sorted(r[:3] for r in brute.exact(CORNERS))
    kept = [r["doc_id"] for r in out.filter("kept").collect()]
    assert sorted(kept) == sorted({r[1] for r in brute.exact(CORNERS)})  # one row each, also of the repeated row 9
    assert exact_dedup.with_duplicates(empty).count() == 0


def test_exact_duplicates_of_the_table(spark, tiny_rows):
    assert rows_of(queries.op7_exact_dedup(spark, TINY), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(tiny_rows))


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b  c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.with_duplicates(df).collect()) == \
        [(0, 0, 1, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True)]
    near = minhash.near_groups(df, 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near) == [(0, 0), (0, 3), (0, 3), (3, 3)]
    assert simhash.edited_likeness(df).count() == 4 and mixing.mix(df.selectExpr("*", "'s' AS source")).count() == 4
    assert repeats.without_repeats(df).count() == 4


# --- repeated passages -----------------------------------------------------------------------

def repeated(df, **options):
    out = repeats.without_repeats(df, **options).collect()
    return sorted((r["doc_id"], len((r["text"] or "").encode()), len((r["text"] or "").encode()) - len(r["kept_bytes"]),
                   len(r["spans"]), digest(r["kept_bytes"])) for r in out)


@pytest.mark.parametrize("hot", [6000, 1])
def test_repeats(corners, hot):
    short = corners.filter("length(text) < 20000 OR text IS NULL")
    rows = [r for r in CORNERS if len(r[1] or "") < 20000]
    assert repeated(short, hot=hot) == sorted(brute.repeats(rows, 400))


@pytest.mark.parametrize("length", [37, 64])
def test_repeats_of_other_lengths(spark, length):
    rnd = random.Random(length)
    unit = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 90))) for _ in range(12)]
    rows = [(k, "".join(rnd.choice(unit) for _ in range(rnd.randrange(0, 9)))) for k in range(60)] + [(99, "a" * 500), (98, "ab" * 300)]
    assert repeated(spark.createDataFrame(rows, "doc_id long, text string"), length=length) == sorted(brute.repeats(rows, length))


def test_repeats_of_the_table(spark, tiny_rows, empty):
    got = rows_of(queries.op9_repeats(spark, TINY), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(tiny_rows, 400))
    assert repeats.without_repeats(empty).count() == 0


# --- mixing ----------------------------------------------------------------------------------

def test_mix(corners, empty):
    got = mixing.mix(corners, block=16).collect()
    assert len(got) == len(CORNERS)
    size = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    target, taken = brute.targets(size), {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(corners.repartition(2), block=16).collect()))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(corners).columns == corners.columns and mixing.mixed_documents(empty).count() == 0


def test_mix_caps(spark):
    rows = [(k, f"s{k:02d}", "w " * n) for k, n in enumerate([1000, 10, 0, 3, 500, 5, 7, 1])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.mix(df, block=4).collect()}
    wanted = brute.targets({s: len(t.split()) for _, s, t in rows})
    assert all(got[s][0] == pytest.approx(wanted[s]) and abs(got[s][1] - wanted[s]) <= 1 for s in wanted)


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 500.0, 500), (1, 300.0, 300), (2, 200.0, 200)], "no long, target double, n_slots long")
    assert sorted((r["no"], r["count"]) for r in mixing.schedule(sources, 1).groupBy("no").count().collect()) == \
        [(0, pytest.approx(500, abs=5)), (1, pytest.approx(300, abs=5)), (2, pytest.approx(200, abs=5))]


def test_interleaved(spark):
    """Pieces follow the schedule: every stretch holds the sources in nearly their shares."""
    rnd = random.Random(4)
    rows = [(k, f"s{k % 3}", " ".join(f"w{i}" for i in range(rnd.randrange(1, 200)))) for k in range(600)]
    rows += [(1000, "s0", "same old words")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = sorted(mixing.interleaved(df, block=16).collect(), key=lambda r: (r["slot"], r["at"]))
    plan = mixing.mix(df, block=16).collect()
    taken = {}
    for r in got:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["length"]
    assert taken == {d: n for d in {r["doc_id"] for r in plan} if (n := sum(r["taken"] for r in plan if r["doc_id"] == d))}
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])
        assert r["at"] + r["length"] <= 16
    target = {r["source"]: r["target"] for r in plan}
    run, total, share = dict.fromkeys(target, 0), sum(target.values()), {}
    for r in got:
        run[r["source"]] += r["length"]
        share[r["slot"]] = max(abs(run[s] - sum(run.values()) * target[s] / total) for s in target)
    assert max(share.values()) <= 12 * 16
    # Whole rows come in the order in which the slots take their first words.
    out = [r["doc_id"] for r in mixing.mixed_documents(df, block=16).collect()]
    begins = [r["doc_id"] for r in got if r["begin"] == 0]
    at = 0
    for d in out:
        at = begins.index(d, at) + 1
    assert len(begins) - 3 <= len(out) <= len(begins)


def test_mixed_documents_of_long_documents(spark):
    """A source of a single document longer than twice its target keeps it, one of several the nearest in size."""
    rows = [(1, "a", "w " * 20_000), (2, "b", "w " * 300), (3, "c", "w " * 40)]
    rows += [(10 + k, "d", "w " * n) for k, n in enumerate([60_000, 50_000, 70_000])] + [(20, "e", ""), (21, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    plan = mixing.mix(df, weights=(1, 500, 500, 30, 1, 1), repeat=3).collect()
    target = {r["source"]: r["target"] for r in plan}
    assert 0 < target["a"] * 2 < 20_000
    got = sorted(r["doc_id"] for r in mixing.mixed_documents(df, weights=(1, 500, 500, 30, 1, 1), repeat=3).collect())
    size = {r["doc_id"]: r["size"] for r in plan}
    words = {s: sum(size[d] for d in got for r in rows if r[0] == d and r[1] == s) for s in "abcdef"}
    assert got.count(1) == 1 and got.count(2) == 3 and got.count(3) == 3 and not words["e"] and not words["f"]
    assert 0 < words["d"] and abs(words["d"] - target["d"]) <= 35_000
    # A target below one word has no slot.
    tiny = spark.createDataFrame([(1, "a", "w " * 9), (2, "b", "w w"), (3, "b", "w " * 6)], "doc_id long, source string, text string")
    assert [r["doc_id"] for r in mixing.mixed_documents(tiny, weights=(100, 1), repeat=1.9).collect()] == [1, 1, 2]


# --- fingerprints ----------------------------------------------------------------------------

def test_edited_likeness(corners, empty):
    short = corners.filter("doc_id <> 9").select("doc_id", "text")
    got = {r["doc_id"]: r for r in simhash.edited_likeness(short, partitions=7).collect()}
    rows = sorted(((d, t or "") for d, t in CORNERS if d != 9), reverse=True)
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == digest((t[:len(t) - n] + after[:n]).encode()), d
        assert got[d]["near_next"] == pytest.approx(1 - bin((got[d]["fingerprint"] ^ got[rows[(k + 1) % len(rows)][0]]["fingerprint"]) & (2**64 - 1)).count("1") / 64)
        assert 0 <= got[d]["near_edited"] <= 1
    assert got[10]["fingerprint"] == got[11]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"]
    assert simhash.edited_likeness(empty).count() == 0
    assert simhash.edited_likeness(short.limit(1)).count() == 1


def test_edited_likeness_of_ties_and_nulls(spark, monkeypatch):
    """Ranges of single rows cut anywhere: among rows of one id, null ids, identical rows in blocks of any size."""
    monkeypatch.setattr(simhash, "_COPIES", 3)
    rnd = random.Random(21)
    rows = [(rnd.choice([None, 7, 7, rnd.randrange(40)]), " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(12))) or None) for _ in range(80)]
    rows += [(7, "same text here")] * 9 + [(None, "same text here")] * 4 + [(None, None)] * 3 + [(-2**63, "least"), (2**63 - 1, "most")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {n: sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *r[1:]) for r in simhash.edited_likeness(df, partitions=n).collect())) for n in (1, 1000)}
    assert got[1] == got[1000] and len(got[1]) == len(rows)
    hashed = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr(
        "doc_id", "text", "xxhash64(text) AS h1", "xxhash64(1, text) AS h2").collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["h1"], r["h2"], r["text"]) for r in hashed), reverse=True)
    want = []
    for k, (some, key, _, _, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][4], len(t) // 3
        want.append((some, key, len(t), digest((t[:len(t) - n] + after[:n]).encode())))
    assert [r[:4] for r in got[1]] == sorted(want)


def test_fingerprints_part_words_at_all_white_space(spark):
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    edited = words[:150] + ["other"] + words[151:]
    wrapped = "".join(w + ("\r\n" if k % 9 == 8 else " ") for k, w in enumerate(words))
    texts = [" ".join(words), "\t".join(words), "\n".join(words), "\x0b".join(words), "\x0c\r".join(words), wrapped,
             "\n".join(" " * 12 + w for w in words), "       ".join(words) + "  ", "\n".join(edited), "", " \t\n ", None, "one", " one\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [r["fingerprint"] for r in simhash.fingerprints(df, ["k"], "text").orderBy("k").collect()]
    votes = [0] * 64
    terms = spark.createDataFrame(list(zip(["", *words], words)), "a string, b string").selectExpr("xxhash64(a, b) AS h")
    for r in terms.collect():
        for b in range(64):
            votes[b] += (r["h"] >> b) & 1
    assert {x & (2**64 - 1) for x in got[:8]} == {sum((2 * v > len(words)) << b for b, v in enumerate(votes))}
    assert ((got[8] ^ got[0]) & (2**64 - 1)).bit_count() <= 10
    assert got[9] == got[10] == got[11] != got[12] == got[13]


def test_within_radius(spark):
    rnd = random.Random(9)
    some = [rnd.getrandbits(64) for _ in range(150)]
    some += [x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))) for x in some for _ in range(3)]
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    df = spark.createDataFrame([(x,) for x in signed] + [(None,)], "fingerprint long")
    for radius, blocks in ((3, 6), (2, 4), (0, 2)):
        got = {(r["query"], r["found"], r["distance"]) for r in simhash.within_radius(df, df, radius, blocks).collect()}
        far = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in signed for b in signed}
        assert got == {x for x in far if x[2] <= radius}


def test_fingerprint_queries(spark, tiny_rows):
    got = queries.op3_simhash(spark, TINY).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert len(got) == len(prints) == len(tiny_rows)
    for r in got:
        near = sum((prints[r["doc_id"]] ^ x).bit_count() <= 3 for x in prints.values())
        assert r["n_within"] == (near if r["doc_id"] % 20 == 0 else None)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


# --- tokenizers ------------------------------------------------------------------------------

def test_pieces(spark, corners, tiny_rows):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in queries.op4_pieces(spark, TINY).collect()}
    for d, t in tiny_rows:
        ids = model.encode(t or "")
        assert tuple(got[d])[1:] == (len(ids), digest(",".join(map(str, ids)).encode()), digest(model.decode(ids).encode()))
    for r in pieces.with_pieces(corners, path).collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == model.decode(r["ids"])
    apart = corners.select("text", pieces.encode(corners["text"], path).alias("ids"))
    for r in apart.select("text", "ids", pieces.decode(apart["ids"], path).alias("decoded")).collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == model.decode(r["ids"])


def test_pieces_of_odd_strings():
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, mine, rnd = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path, pairs_kept=500), random.Random(4)
    names = list(mine.id_of)
    odd = ["", " ", "  a", "▁", "a▁▁ b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x", "\n\n\n", "<s></s><unk><0x0A>", "\x00"]
    odd += ["".join(rnd.choice("ab ▁\ncdethe in1.,🙂éß中<>") for _ in range(rnd.randrange(60))) for _ in range(800)]
    odd += ["".join(rnd.choice(names) for _ in range(rnd.randrange(12))) for _ in range(800)]
    for t in odd:
        assert not t or mine.ids(pieces.MARK + t.replace(" ", pieces.MARK)) == model.encode(t), t
    ids, borders = mine.encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == [model.encode(t) for t in odd]
    assert mine.decode(ids, borders) == [model.decode(model.encode(t)) for t in odd]
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(len(names)), rnd.randrange(3, 259)]) for _ in range(6)]
        assert mine.decode(np.array(ids, np.int32), np.array([0, 6])) == [model.decode(ids)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units(name):
    from tracelathe.llm import token_units
    rnd = random.Random(8)
    t = token_units.tokenizer(public_tokenizers.path(name))
    odd = ["<|endoftext|>", "a  <|endoftext|> <|startoftext|> b", " \n\n x  y", "　  x", "é É", "!\x1c!", "it's  they'll"]
    odd += ["".join(rnd.choice("ab \n\t'sZ1.!é \x1ć中🙂") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    for x in odd + [r[1] or "" for r in CORNERS]:
        got = [i for u in token_units.units(x) for i in t.encode(u, add_special_tokens=False).ids]
        assert got == t.encode(x, add_special_tokens=False).ids, x


def test_token_counts(spark, corners, empty, tiny_rows):
    from tracelathe.llm import token_units
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = token_units.tokenizer(path)
    for r in token_counts.with_token_counts(corners.withColumn("n_tokens", corners["doc_id"]), path).collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len((r["text"] or "").encode()))
    assert token_counts.with_token_counts(empty, path).count() == 0
    assert len(tiny_rows) == queries.op8_token_counts(spark, TINY).count()


def test_simple8b():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 59, 60, 61, 4095, 4096, 4097, 20_000):
        for top in (1, 2, 3, 17, 50_000, 2**31, 2**61):
            v = (rnd.integers(0, top, n) * rnd.integers(0, 2, n)).astype(np.uint64)
            data, words, escapes = token_store.pack(v)
            assert (token_store.unpack_all(data, words, escapes, n) == v).all()
            assert sum(words) + sum(escapes) == len(data) // 8
    wide = np.array([1, 2**63, 2**64 - 1, 0, 2**60 - 1], np.uint64)
    assert (token_store.unpack_all(*token_store.pack(wide), len(wide)) == wide).all()


def test_token_store(spark, corners, empty, tmp_path):
    from tracelathe.llm import token_units
    path = public_tokenizers.path("word_bpe_49k.json")
    t, start = token_units.tokenizer(path), 0
    token_store.write_tokens(corners, str(tmp_path / "a"), path, 2, segment_ids=1000)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in token_store.read_tokens(spark, str(tmp_path / "a")).collect())
    for (d, text), row in zip(sorted(CORNERS, key=lambda r: (r[0], r[1] or "")), got):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert row == (d, start, len(ids), ids.tobytes())
        start += len(ids)
    token_store.write_tokens(empty, str(tmp_path / "b"), path, 2)
    assert token_store.read_tokens(spark, str(tmp_path / "b")).count() == 0
    one = queries.op10_token_store(spark, TINY).orderBy("doc_id").first()
    text = spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").first()["text"]
    assert one["ids_crc32"] == zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_token_queries_row_by_row(spark, tiny_rows):
    from tracelathe.llm import token_units
    t, start = token_units.tokenizer(public_tokenizers.path("byte_bpe_50k.json")), 0
    wanted = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in tiny_rows]
    assert rows_of(queries.op8_token_counts(spark, TINY), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(wanted)
    t, wanted = token_units.tokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    for d, x in sorted(tiny_rows):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(queries.op10_token_store(spark, TINY), "doc_id", "start", "n_tokens", "ids_crc32") == wanted


# --- learned operators -----------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    names = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "▁ab": 6}
    p = np.random.default_rng(0).random((7, 2))

    def total(s, k):
        return 1.0 if not s else sum((p[names[s[:j]], k] if s[:j] in names else langid.UNKNOWN if j == 1 else 0.0) * total(s[j:], k) for j in range(1, min(3, len(s)) + 1))

    for s in ("a", "abab", "bz", "abbaabab" * 5):
        got = langid.log_probabilities([s], names, langid.with_ends(p))[0] if len(s) < 12 else None
        if got is not None:
            assert got == pytest.approx([np.log(total("▁" + s, k)) for k in (0, 1)])
    long = langid.log_probabilities(["ab" * 4000], names, langid.with_ends(p))
    assert np.isfinite(long).all() and long[0, 0] < -1000 * 0.1


def test_long_words_teach():
    names = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "▁ab": 6, "c": 7}
    learn = lambda words: langid.learn_pieces(words, np.ones(len(words)), names)
    long, other = learn(["ab" * 60, "ab" * 21]), learn(["c" * 41, "c" * 90])
    assert long[3] > 0.5 > 10 * long[7] and other[7] > 0.5
    assert (long > 0).all() and np.isfinite(long).all() and long.sum() == pytest.approx(1)
    table = langid.with_ends(np.stack([long, other], axis=1))
    assert langid.log_probabilities(["ab" * 100, "c" * 100], names, table).argmax(axis=1).tolist() == [0, 1]
    assert langid.learn_pieces([], np.zeros(0), names) == pytest.approx(np.full(8, 1 / 8))


def test_language(spark, corners, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = {r["doc_id"]: r for r in langid.with_language(corners, docs, path).collect()}
    assert (out[1]["lang_pred"], out[2]["lang_pred"], out[3]["lang_pred"], out[1]["score"]) == ("und", "und", "und", 0.0)
    assert langid.with_language(empty, docs, path).count() == 0
    assert {r["lang_pred"] for r in langid.with_language(corners, empty, path).collect()} == {"und"}


def test_quality(spark, corners, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op5_quality(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area >= 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    model = quality.learn(spark.read.parquet(f"{sf}/documents.parquet"), labels, per_class=50)
    assert quality.with_quality(corners, model).count() == len(CORNERS) and quality.with_quality(empty, model).count() == 0
    assert quality.learn(empty, labels.limit(0)) is None and quality.with_quality(corners, None).count() == len(CORNERS)


def test_units_are_kept_in_few_bytes():
    import tracemalloc

    words = [f"u{k}" for k in range(60_000)] + [f"a longer unit {k}" for k in range(60_000)]
    table = byte_units.UnitTable(lambda units: [[len(u)] for u in units], slots=1 << 10)
    tracemalloc.start()
    for a in range(0, len(words), 20_000):
        part = byte_units.Slice(words[a:a + 20_000])
        table.lookup(part, part.begins, part.ends)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert table.n == len(words) and kept / table.n < 130, kept / table.n
    part = byte_units.Slice(words[::7])
    again = table.lookup(part, part.begins, part.ends)
    assert again.max() < len(words) and table.n == len(words)
    assert table.expand(again)[0].tolist() == [len(w) for w in words[::7]]


def test_encoding_takes_small_batches(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id int, text string")
    pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= 1 << 21
