import math
import statistics

import pytest

from tracelathe.operators import access_patterns as ap, registers


def test_register_values_edges(access_of):
    access = access_of(
        [("t", i, "R", "two", i) for i in range(2)] + [("t", 10 + i, "R", "const", 7) for i in range(3)]
        + [("t", 20 + i, "W", "vals", v) for i, v in enumerate([1, 4, 2, 2])]
        + [("t", 30 + i, "W", "wide", v) for i, v in enumerate([2**64, 2**64 + 3, 2**64 + 1])])
    got = {r.descr: r for r in registers.register_values(access).collect()}
    assert set(got) == {"const", "vals", "wide"}
    c, v, w = got["const"], got["vals"], got["wide"]
    assert (c.n, c.std, c.n_unique, c.change_frequency, c.n_transitions) == (3, 0.0, 1, 0.0, 1)
    assert (int(v.min), int(v.max), v.mean, v.median, v.n_unique, int(v.range)) == (1, 4, 2.25, 2.0, 3, 3)
    assert v.std == pytest.approx(statistics.pstdev([1, 4, 2, 2]))
    assert (v.mean_diff, v.max_diff, v.change_frequency, v.n_transitions) == (pytest.approx(1 / 3), 3.0, pytest.approx(2 / 3), 3)
    assert (v.bits_ever, v.bits_always, v.bits_toggled) == (7, 0, 7)
    assert v.mean_popcount == 1.0 and v.mean_hamming == pytest.approx((2 + 2 + 0) / 3)
    assert int(w.max) == 2**64 + 3 and w.max_diff == 3.0 and w.mean_diff == 0.5 and w.bits_ever is None


def test_chunks_do_not_change_values(access_of):
    access = access_of([("t", i, "R" if i % 3 else "W", f"r{i % 2}", (i * 37) % 11) for i in range(40)])
    pick = lambda d: sorted(str((r.descr, r.n, round(r.diff_std, 9), r.n_transitions, r.median)) for r in d.collect())
    assert pick(registers.register_values(access)) == pick(registers.register_values(access, chunk_lines=3))
    key = lambda d: sorted(str(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r)) for r in d.collect())
    assert key(ap.kind_intervals(access)) == key(ap.kind_intervals(access, chunk_lines=2))


def test_importance_attached(spark, access_of):
    access = access_of([("t", i, "R", "a", i) for i in range(3)] + [("t", 9 + i, "R", "b", i) for i in range(3)])
    imp = spark.createDataFrame([("a", 0.9)], "descr string, importance double")
    assert {r.descr: r.importance for r in registers.register_values(access, imp).collect()} == {"a": 0.9, "b": 0.0}


def test_histogram_entropy(access_of):
    access = access_of([("t", i, "R", "h", v) for i, v in enumerate([0, 1, 10])] + [("t", 5 + i, "R", "k", 4) for i in range(3)])
    got = {r.descr: r.entropy for r in registers.value_vectors(access).collect()}
    assert got["h"] == pytest.approx(math.log(3)) and got["k"] == 0.0


def test_access_vectors_thresholds_and_gaps(access_of):
    access = access_of([("t", 1_000_000_000 * s, a, "r", 1) for s, a in [(0, "R"), (4, "R"), (2, "R"), (9, "W")]]
                       + [("t", 5, "R", "few", 1), ("t", 6, "W", "few", 1)])
    rows = registers.access_vectors(access).collect()
    assert [r.descr for r in rows] == ["r"]
    assert (rows[0].reads, rows[0].writes, rows[0].read_gap, rows[0].write_gap) == (3, 1, 1.0, 0.0)


def test_relative_seconds(access_of, spark):
    access = access_of([("t", 5_000_000_000, "R", "a", 1), ("t", 2_000_000_000, "R", "a", 1)])
    got = {r.line_id: r.relative_time for r in registers.relative_seconds(access).collect()}
    assert got == {0: 3.0, 1: 0.0}
    huge = access_of([("t", 10**25, "R", "a", 1), ("t", 7, "R", "a", 1)])
    assert {r.line_id: r.relative_time for r in registers.relative_seconds(huge).collect()} == {0: 0.0, 1: 1.0}


def test_ratio_infinite_without_writes(access_of):
    rows = ap.rw_ratio(access_of([("t", 1, "R", "a", 1), ("t", 2, "R", "b", 1), ("t", 3, "W", "b", 1)])).collect()
    assert {r.descr: r.rw_ratio for r in rows} == {"a": float("inf"), "b": 1.0}


def test_intervals_need_three_accesses(access_of):
    access = access_of([("t", ts, "R", "a", 1) for ts in (0, 3_000_000_000, 1_000_000_000)]
                       + [("t", 0, "R", "b", 1), ("t", 1, "W", "b", 1)])
    rows = ap.interval_stats(access).collect()
    assert [r.descr for r in rows] == ["a"]
    r = rows[0]
    assert (r.read_mean_interval, r.mean_interval, r.max_interval, r.access_frequency) == (0.5, 1.5, 2.0, 1.0)
    assert r.read_std_interval == 2.5 and r.write_mean_interval is None


def test_bursts_inclusive_gap(access_of):
    access = access_of([("t", ts, "R", "a", 1) for ts in (0, 1000, 2001, 9000, 9001, 9002)] + [("t", 0, "R", "b", 1)])
    found = ap.bursts(access)
    assert sorted((r.start_ns, r.end_ns, r.length) for r in found.collect()) == [(0, 1000, 2), (9000, 9002, 3)]
    s = ap.burst_stats(found).collect()[0]
    assert (s.n_bursts, s.mean_len, s.max_len, s.total_accesses) == (2, 2.5, 3, 5)
