"""Records over several lines: as in the whole text, wherever lines and chunks end."""

import random

import pytest

from tracelathe.operators import parse, spanning

RECORDS = ["[100] MEM_R [0x10] 32b core.status 0x1F <-- poll it", "[200] MEM_W [0x14] 64b a b[7].c 0xff", "UVM_ERROR : time out",
           "Sleep State FSM transition: S0 -> S3", "FSM pwr: IDLE -> RUN", "noise regs[7]", "0x55 0x66", "[7]", "x -> y", "ERROR: last 0x1"]


def found(spark, lines):
    """Everything the parser finds, without line ids and places."""
    access = [("a", r.ts_ns, r.action, r.address, r.descr, r.value_hex, r.comment) for r in parse.parse_access(lines).collect()]
    fsm = [("f", r.kind, r.fsm_name, r.from_state, r.to_state, r.ts_text) for r in parse.parse_fsm(lines).collect()]
    return sorted(access + fsm + [("e", r.message, r.ts_text) for r in parse.parse_errors(lines).collect()])


GOLDENS = {
    "value on the next line": (["[1] MEM_R [0x1] 32b a.b", "  0x5", "[2] MEM_W [0x1] 32b a.b 0x6"], ["a.b 0x5 ", "a.b 0x6 "]),
    "three lines": (["[1] MEM_R", "[0x1] 32b a.b", "0x5 <-- seen"], ["a.b 0x5 seen"]),
    "description alone": (["[1] MEM_R [0x1] 32b", "a b", "0x5"], ["a b 0x5 "]),
    "blank lines between": (["[1]", "", " \t", "MEM_R [0x1] 32b a.b 0x5"], ["a.b 0x5 "]),
    "comment on the next line": (["[1] MEM_R [0x1] 32b a.b 0x5", "<-- seen", "<-- not"], ["a.b 0x5 seen"]),
    "a line taken as comment": (["[1] MEM_R [0x1] 32b a.b 0x5 <--", "[2] MEM_R [0x1] 32b c 0x6"], ["a.b 0x5 [2] MEM_R [0x1] 32b c 0x6"]),
    "a dump is no record": (["0x1 0x2", "0x3 0x4", "32b", "[3]"], []),
}


@pytest.mark.parametrize("name", GOLDENS)
def test_goldens(lines_of, name):
    texts, want = GOLDENS[name]
    rows = parse.parse_access(spanning.joined(lines_of(*texts))).orderBy("line_id", "pos").collect()
    assert [f"{r.descr} {r.value_hex} {r.comment}" for r in rows] == want


def test_transitions_and_errors_over_lines(spark, lines_of):
    lines = spanning.joined(lines_of("[5]", "Sleep", "State FSM", "transition:", "S0", "-> S3", "FSM", "pwr:", "IDLE ->", "RUN", "UVM_ERROR", ":", "time out"))
    assert found(spark, lines) == [("e", "time out", "5"), ("f", "generic", "pwr", "IDLE", "RUN", "5"),
                                   ("f", "generic", "transition", "S0", "S3", "5"), ("f", "sleep", "SleepStateFSM", "S0", "S3", "5")]


@pytest.mark.parametrize("chunk_lines", [1 << 20, 1, 3])
def test_equal_to_the_whole_text(spark, lines_of, chunk_lines):
    """Random breaks at white space; all runs at once, each against its text as one line."""
    rnd, rows, whole = random.Random(chunk_lines), [], []
    for k in range(60):
        text = " ".join(rnd.choice(RECORDS) + "\n" for _ in range(8))
        text = "".join(rnd.choice(["\n", "\n\n", " \n "]) if c == " " and rnd.random() < 0.25 else c for c in text)
        rows += [(f"t{k}", i * 3, t) for i, t in enumerate(text.split("\n"))]
        whole.append((f"t{k}", 0, text))
    schema = "test_id string, line_id long, raw string"
    lines, texts = spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(whole, schema)
    got = found(spark, spanning.joined(lines, chunk_lines))
    assert got == found(spark, texts) and len(got) > len(found(spark, lines))


def test_lines_without_signs_are_left_alone(lines_of):
    lines = lines_of("[1] MEM_R [0x1] 32b a.b 0x5", "FSM pwr: IDLE -> RUN", "plain text")
    assert spanning.joined(lines) is lines


def test_ingest_scans_the_text_once(spark, tmp_path, monkeypatch):
    """One plan reads the text; accesses are typed behind the range shuffle; all marks share one as-of pass."""
    from tracelathe.operators import carry
    from tracelathe.plans import engine

    (tmp_path / "trace.txt").write_text("\n".join(
        f"[{i}] MEM_R [0x1] 32b r[{i}] 0x{i:x}\nFSM m: a -> b\nERROR: e{i}" for i in range(30)))
    lines = spark.read.text(str(tmp_path)).selectExpr("'t' AS test_id", "monotonically_increasing_id() AS line_id", "value AS raw")
    plans, real = {}, engine.materialize

    def recording(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    for module in (engine, carry, spanning):
        monkeypatch.setattr(module, "materialize", recording)
    got = engine.parse_tables(lines, engine.Options(ts_source="record"))
    assert list(plans) == ["records", "access", "marks", "fsm", "err"]
    assert [name for name, plan in plans.items() if "Relation [value" in plan] == ["records"]
    access = plans["access"].splitlines()
    cut = next(i for i, line in enumerate(access) if "RepartitionByExpression" in line)
    assert not any("split(" in line for line in access[cut:])
    assert plans["marks"].count("Window [last(") == 2  # within chunks, and over their seams
    assert [got[k].count() for k in ("access", "fsm", "err")] == [30, 30, 30]
    assert {(r.message, r.ts_ns) for r in got["err"].collect()} == {(f"e{i}", i) for i in range(30)}
    assert sorted(r[:] for r in got["access"].drop("tchunk").collect()) == sorted(r[:] for r in parse.parse_access(lines).collect())


@pytest.mark.parametrize("dedupe", [False, True])
def test_ingest_of_broken_records(spark, lines_of, dedupe):
    """Only lines of records that span them are matched anew, and each is found once."""
    from tracelathe.plans import engine

    lines = lines_of("[1] MEM_R [0x1] 32b a.b", "  0x5", "[2] MEM_W [0x1] 32b a.b 0x6", "Sleep State FSM", "transition: S0 -> S3",
                     "FSM pwr: IDLE -> RUN", "UVM_ERROR :", "late")
    got = engine.parse_tables(lines, engine.Options(dedupe_sleep=dedupe))
    assert [(r.line_id, r.ts_ns, r.value_hex) for r in got["access"].orderBy("line_id").collect()] == [(0, 1, "0x5"), (2, 2, "0x6")]
    want = [(3, "SleepStateFSM", 2), (5, "pwr", 2)] + [(3, "transition", 2)] * (not dedupe)
    assert sorted((r.line_id, r.fsm_name, r.ts_ns) for r in got["fsm"].collect()) == sorted(want)
    assert [(r.line_id, r.message, r.ts_ns) for r in got["err"].collect()] == [(6, "late", 2)]
