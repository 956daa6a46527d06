"""The line scan's shortcuts and the neighbour grid against the plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tracelathe.operators import cluster, parse, spanning

ENDINGS = ["32b", "] 7b", "<--", "->", "ERROR", "ERROR :", ":", "FSM", "FSM a:", "Sleep", "State", "transition:", "MEM_R", "MEM_W", "x", "9", "purchase",
           "signup", "0xab", "", "ebb"]


def test_signs_are_those_of_every_pattern(spark):
    heads = ["", "MEM_R [", "0x1 ", "<-- c", "-> b ", ": x ", "12b ", "[0x1f] ", "MEM_Rx ", "5bx ", "ab ", "a 0x1 "]
    texts = [f"{s}{h}q {e}{t}" for s in ("", "\t ", " ") for h in heads for e in ENDINGS for t in ("", "  ", "\t", " \r", "　", "\n")]
    texts += [f"{e}{t}" for e in ENDINGS for t in ("", " ", "\t\t")]
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    raw, plain = F.col("raw"), F.lit(False)
    for p in [*spanning.ENDS.values(), *spanning.HEADS.values()]:
        plain = plain | raw.rlike(p)
    ends = spanning._code(raw, spanning.ENDS) != 0
    assert df.where(spanning.signs(raw) != plain).collect() == []
    assert df.where(ends & spanning._plain_end(raw)).collect() == []
    assert df.where(spanning._plain_end(raw)).count() > 300


def test_marks_that_share_a_line(spark):
    text = "[5] MEM_R x FSM A: a -> b [7] MEM_W y FSM B: b -> c é Sleep State FSM transition: s -> t"
    df = spark.createDataFrame([("t", 1, text)], "test_id string, line_id long, raw string")
    marks = parse.found(df, "record").select(F.explode("marks").alias("m")).select("m.*").collect()
    assert [(m.kind, m.pos, m.raw, m.own, m.after_sleep) for m in marks] == [
        ("sleep", 0, "Sleep State FSM transition: s -> t", "7", False), ("generic", 0, "FSM A: a -> b", "5", False),
        ("generic", 1, "FSM B: b -> c", "7", False), ("generic", 2, "FSM transition: s -> t", "7", True)]


def test_near_cells_are_all_pairs_within_the_radius(spark):
    rng, eps = random.Random(3), 0.5
    side = eps / 3 ** 0.5 * (1 - 1e-12)
    points = [(g, [rng.gauss(0, 0.6) for _ in range(3)]) for g, n in (("few", 30), ("many", 400)) for _ in range(n)]
    sites = (spark.createDataFrame(points, "k string, v array<double>")
             .withColumn("cell", F.transform("v", lambda x: F.floor(x / side).cast("bigint"))))
    cells = cluster._boxes(sites, ["k"], 3).cache()
    found = cluster._near_cells(cells, ["k"], [0, 2], eps * eps, 3, side).collect()
    rows = cells.collect()
    assert len([r for r in rows if r.k == "many"]) > cluster.FEW_CELLS
    gap = lambda a, b: sum(max(x - w, y - z, 0.0) ** 2 for x, z, y, w in zip(a.lo, a.hi, b.lo, b.hi))
    wanted = {(a.k, tuple(a.cell), tuple(b.cell)) for a in rows for b in rows if a.k == b.k and gap(a, b) <= eps * eps}
    assert len(found) == len(wanted) and {(r.k, tuple(r.cell_a), tuple(r.cell_b)) for r in found} == wanted


def _brute(points, eps, least):
    """Cluster of each (place in the list) by definition: numbered by the earliest core point, border points to the lowest."""
    near = [[j for j, q in enumerate(points) if sum((x - y) ** 2 for x, y in zip(p, q)) <= eps * eps] for p in points]
    core, label, n = {i for i, js in enumerate(near) if len(js) >= least}, {}, 0
    for i in sorted(core):
        if i not in label:
            todo, label[i] = [i], n
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = n
                        todo.append(j)
            n += 1
    return label | {i: min(label[j] for j in near[i] if j in core) for i in range(len(points)) if i not in core and core & set(near[i])}


@pytest.fixture
def stored(monkeypatch):
    """What clustering stores: name -> rows of each table."""
    tables, real = {}, cluster.materialize

    def recording(df, name):
        out = real(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(cluster, "materialize", recording)
    return tables


@pytest.mark.parametrize("spread_by", [0.15, 0.45, 1.1])
def test_clusters_of_groups_match_their_definition(spark, spread_by):
    rng = random.Random(7)
    groups = {k: [[rng.gauss(c, spread_by) for c in (rng.choice((0, 2)), 0, rng.choice((0, 1.5)))] for _ in range(n)] for k, n in (("a", 170), ("b", 90), ("c", 4))}
    groups["a"] += [groups["a"][3]] * 6 + [[9.0, 9.0, 9.0]] * 5
    rows = [(k, f"r{i}", i, *p) for k, ps in groups.items() for i, p in enumerate(ps)] + [(None, "r", i, 0.0, 0.0, 0.0) for i in range(8)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "test_id string, descr string, first_at long, x double, y double, z double")
    got = cluster.density_clusters(df, ["x", "y", "z"]).collect()
    want = {(k, i): c for k, ps in groups.items() for i, c in _brute(ps, 0.5, 5).items()}
    assert len(got) == len(want) and {(r.test_id, r.first_at): r.cluster_id for r in got} == want
    assert all(r.descr == f"r{r.first_at}" for r in got)


def test_sites_are_compared_only_where_boxes_leave_something_open(spark, stored):
    """In a dense cloud boxes link all cells and give all points their neighbours: no site is held against another."""
    points = [("t", f"r{i}", i, x / 20, y / 20, 0.0) for i, (x, y) in enumerate((x, y) for x in range(40) for y in range(40))]
    df = spark.createDataFrame(points, "test_id string, descr string, first_at long, x double, y double, z double")
    got = cluster.density_clusters(df, ["x", "y"] + ["z"] * 5, grid=[0, 1])
    assert {r.cluster_id for r in got.collect()} == {0} and got.count() == 1600
    assert stored["near-cells"][0] > 500
    assert [stored[t] for t in ("thin-cells", "probe", "cell-pairs", "facing")] == [[0], [0], [0], [0]]


def test_long_chains_take_few_rounds(spark, stored):
    ends = [(i, i + 1) for i in range(300)] + [(5000 - i, 4999 - i) for i in range(300)] + [(900, j) for j in range(901, 1000)]
    nodes = sorted({x for e in ends for x in e} | {7777})
    found = cluster._components(spark.createDataFrame([(n,) for n in nodes], "cell long"), spark.createDataFrame(ends, "cell_a long, cell_b long"))
    root = lambda n: 0 if n <= 300 else 900 if n < 1000 else 4700 if n <= 5000 else n
    assert {r.cell: r.label for r in found.collect()} == {n: root(n) for n in nodes}
    assert len(stored["edges"]) <= 2 and len(stored["roots"]) < 14
