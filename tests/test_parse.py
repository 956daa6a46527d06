"""Grammar goldens and values."""

from pyspark.sql import functions as F

from tracelathe.operators import parse

GOLDEN = [
    "[100] MEM_R [0x10] 32b core.status 0x1F <-- poll",
    "[200] MEM_W [0x14] 64b core.regs[7].data 0xffffffffffffffff",
    "UVM_ERROR : timeout",
    "[300] MEM_R [0x18] 32b a.b 0x2 0x3",
    "[350] MEM_R [0x18] 128b a.w 0x1ffffffffffffffff",
    "[400] Sleep State FSM transition: S0 -> S3",
    "[410] FSM pwr: IDLE -> RUN",
    "error: x",
    "[420] MEM_X [0x1] 32b a 0x1",
    "[430] MEM_R [0x1] 32b a 0x1 [431] MEM_W [0x1] 32b a 0x2",
]


def test_access_goldens(lines_of):
    rows = parse.parse_access(lines_of(*GOLDEN)).orderBy("line_id", "pos").collect()
    got = [(r.line_id, r.pos, r.ts_ns, r.action, r.descr, int(r.value), r.comment) for r in rows]
    assert got == [
        (0, 0, 100, "MEM_R", "core.status", 31, "poll"),
        (1, 0, 200, "MEM_W", "core.regs[7].data", 18446744073709551615, ""),
        (3, 0, 300, "MEM_R", "a.b", 2, ""),
        (4, 0, 350, "MEM_R", "a.w", 36893488147419103231, ""),
        (9, 0, 430, "MEM_R", "a", 1, ""),
        (9, 1, 431, "MEM_W", "a", 2, ""),
    ]
    assert [r.is_status for r in rows] == [True, False, False, False, False, False]
    assert [r.is_array for r in rows] == [False, True, False, False, False, False]
    assert rows[1].value_bits == -1 and rows[3].value_bits is None
    assert rows[3].value_d == float(0x1ffffffffffffffff)


def test_transitions_and_errors(lines_of):
    lines = lines_of(*GOLDEN)
    key = lambda r: (r.line_id, r.kind, r.fsm_name, r.from_state, r.to_state, r.ts_ns)
    assert sorted(map(key, parse.parse_fsm(lines).collect())) == [
        (5, "generic", "transition", "S0", "S3", 400), (5, "sleep", "SleepStateFSM", "S0", "S3", 400),
        (6, "generic", "pwr", "IDLE", "RUN", 410)]
    assert [r.fsm_name for r in parse.parse_fsm(lines, dedupe_sleep=True).orderBy("line_id").collect()] == [
        "SleepStateFSM", "pwr"]
    assert [(r.message, r.ts_ns) for r in parse.parse_errors(lines).collect()] == [("timeout", 7)]
    assert [(r.message, r.ts_ns) for r in parse.parse_errors(lines, "record").collect()] == [("timeout", 200)]


def test_nearest_timestamp_edges(lines_of):
    lines = lines_of("ERROR: first", "[5] note [6]", "plain", "FSM a: x -> y [9] FSM b: x -> z", "ERROR: last")
    fsm = {r.fsm_name: r.ts_text for r in parse.parse_fsm(lines).collect()}
    assert fsm == {"a": "6", "b": "9"}
    assert {r.message: r.ts_text for r in parse.parse_errors(lines).collect()} == {"first": "0", "last": "9"}


def test_chunked_timestamps_equal_unchunked(lines_of):
    texts = []
    for i in range(60):
        texts += [f"[{i * 10}] MEM_R [0x1] 32b r[{i}] 0x1" if i % 7 == 0 else "noise", "FSM m: a -> b", "ERROR: e"]
    lines = lines_of(*texts)
    for source in ("nearest", "record"):
        whole = sorted(r[:] for r in parse.parse_errors(lines, source).collect())
        assert whole == sorted(r[:] for r in parse.parse_errors(lines, source, chunk_lines=2).collect())
        assert sorted(r[:] for r in parse.parse_fsm(lines, ts_source=source).collect()) == sorted(
            r[:] for r in parse.parse_fsm(lines, ts_source=source, chunk_lines=5).collect())


def test_whole_text_record_spans_lines(lines_of):
    text = "[1] MEM_R [0x1] 32b a.b\n  0x5\n[2] MEM_W [0x1] 32b a.b 0x6"
    assert [int(r.value) for r in parse.parse_access(lines_of(text)).orderBy("pos").collect()] == [5, 6]
    assert [int(r.value) for r in parse.parse_access(lines_of(*text.split("\n"))).collect()] == [6]


def test_hex_widths(spark):
    from tracelathe.functions.exprs import hex_bits, hex_decimal, hex_double
    texts = ["0x0", "0x00ff", "0x7fffffffffffffff", "0x8000000000000000", "0x" + "f" * 31, "0x" + "f" * 40, "zz", ""]
    c = F.col("h")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, h string")
    rows = df.select("i", hex_decimal(c).alias("d"), hex_double(c).alias("f"), hex_bits(c).alias("b")).orderBy("i").collect()
    assert [int(r.d) if r.d is not None else None for r in rows] == [
        0, 255, 2**63 - 1, 2**63, 16**31 - 1, None, None, None]
    assert [r.f for r in rows] == [0.0, 255.0, float(2**63 - 1), float(2**63), float(16**31 - 1), float(16**40 - 1), None, None]
    assert [r.b for r in rows] == [0, 255, 2**63 - 1, -2**63, None, None, None, None]


def test_array_names(spark):
    df = spark.createDataFrame([("a.b[1][2].c",), ("plain",), ("x[y]",)], "d string")
    assert [r.n for r in df.select(parse.array_name(F.col("d")).alias("n")).collect()] == ["a.b", "", ""]
