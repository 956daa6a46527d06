"""Raw lines to typed records: register accesses, state transitions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelathe.functions.exprs import hex_bits, hex_decimal, hex_double
from tracelathe.operators import carry
from tracelathe.schema import (ACCESS_COLUMNS, CHUNK_LINES, ERR_COLUMNS, FSM_COLUMNS, READ,
                               SLEEP_FSM, TRANSITION, WRITE)

# The record grammar.
WORD_CHAR = r"[\p{L}\p{N}_]"
ACCESS = (r"(?U)\[(\d+)\]\s+(MEM_[RW])\s+\[(0x[0-9a-fA-F]+)\]\s+(\d+b)\s+"
          r"(\S[^\n]*?)\s+(0x[0-9a-fA-F]+)(?:\s+<--\s+([^\n]+))?")
SLEEP = rf"(?U)Sleep\s+State\s+FSM\s+transition:\s+({WORD_CHAR}+)\s+->\s+({WORD_CHAR}+)"
GENERIC = rf"(?U)FSM\s+({WORD_CHAR}+):\s+({WORD_CHAR}+)\s+->\s+({WORD_CHAR}+)"
ERROR = r"(?U)ERROR\s*:\s*([^\n]+)"
LAST_BRACKETED = r"(?Us)^.*\[(\d+)\]"
LAST_RECORD_TIME = LAST_BRACKETED + r"\s+MEM_[RW]\s"
STRIP = r"(?U)^\s+|\s+$"

# Captured groups never hold a line feed, so it separates them safely.
_FIELDS = 7
#: Marks by kind: what their line holds at least, their pattern, its number of groups.
MARKS = {"sleep": ("Sleep", SLEEP, 2), "generic": ("FSM", GENERIC, 3), "error": ("ERROR", ERROR, 1)}
MARK_TYPE = "array<struct<kind:string,pos:int,raw:string,own:string,after_sleep:boolean>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def _hits(raw: Column, hint: str, pattern: str) -> Column:
    """All matches of ``pattern`` on a line, in order; null where the line lacks ``hint``."""
    return F.when(raw.contains(hint), F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)))


def _last(text: Column | str, ts_source: str) -> Column:
    """The last time in a text: of any bracketed integer, or of an access record only."""
    if ts_source not in ("nearest", "record"):
        raise ValueError(f"unknown ts_source {ts_source!r}")
    pattern = LAST_RECORD_TIME if ts_source == "record" else LAST_BRACKETED
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _marks(raw: Column, kind: str, ts_source: str) -> Column:
    """Marks of one kind on a line: array of (kind, pos, raw, own: time before it on the line, after_sleep)."""
    hint, pattern, _ = MARKS[kind]
    ahead = "(?s)(.*?)" + pattern
    # One pass finds each match with what stands before it; fields of a struct are worked out once, however often they are read.
    pieces = F.when(raw.contains(hint), F.regexp_extract_all(raw, F.lit(ahead), F.lit(0)))
    parted = F.transform(pieces, lambda piece, at: F.struct(at.alias("pos"), piece.alias("piece"), F.regexp_extract(piece, "^" + ahead, 1).alias("gap")))
    placed = F.transform(parted, lambda x: F.struct(
        x["pos"].alias("pos"), F.substr(x["piece"], F.length(x["gap"]) + 1).alias("raw"),
        F.when(x["pos"] == 0, x["gap"]).otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), x["pos"]), ""), x["gap"])).alias("before")))
    marks = F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), x["pos"].alias("pos"), x["raw"].alias("raw"),
                                                   _last(x["before"], ts_source).alias("own"), x["before"].rlike(r"(?U)Sleep\s+State\s+$").alias("after_sleep")))
    return F.coalesce(marks, F.array().cast(MARK_TYPE))


def found(lines: DataFrame, ts_source="nearest", sign: Column | None = None, kinds: tuple[str, ...] = tuple(MARKS)) -> DataFrame:
    """Everything the grammar finds, after one scan of the text: (test_id, line_id, access, marks, bracket, sign).

    One row per line that holds any of it: the texts of its access records, its marks of ``kinds``, the last
    time on it, and whether ``sign`` holds.  Store it to read the text once; each reader takes the columns it needs."""
    raw = F.col("raw")
    signed = F.lit(False) if sign is None else F.coalesce(sign, F.lit(False))
    # Every access record and every time begins with a bracket.
    holds = raw.contains("[") | raw.contains("FSM") | raw.contains("ERROR")
    return lines.where(holds | signed).select(
        "test_id", "line_id", _hits(raw, "MEM_", ACCESS).alias("access"),
        F.concat(*[_marks(raw, kind, ts_source) for kind in kinds]).alias("marks"),
        F.when(raw.contains("MEM_" if ts_source == "record" else "["), _last(raw, ts_source)).alias("bracket"),
        signed.alias("sign"))


def access_records(records: DataFrame) -> DataFrame:
    """The access records of ``found`` by place and time only, their fields still in ``raw``."""
    # Outer, so that Spark does not run the pattern once more to skip empty rows first.
    return (records.select("test_id", "line_id", F.posexplode_outer("access").alias("pos", "raw")).where("pos is not null")
            .withColumn("ts_ns", F.regexp_extract("raw", r"(?U)^\[(\d+)\]", 1).try_cast("bigint")))


def typed_access(rows: DataFrame, *more: str) -> DataFrame:
    """Fields of ``access_records``, with further columns kept."""
    groups = "\n".join(f"${i}" for i in range(1, _FIELDS + 1))
    split = rows.withColumn("_g", F.split(F.regexp_replace("raw", ACCESS, groups), "\n", _FIELDS))
    g = F.col("_g")
    typed = split.select(
        "test_id", "line_id", "pos", "ts_ns", g[0].alias("ts_text"),
        g[1].alias("action"), g[2].alias("address"), g[3].alias("size"),
        _strip(g[4]).alias("descr"), g[5].alias("value_hex"), _strip(g[6]).alias("comment"), "raw", *more)
    return classify(typed).select(*ACCESS_COLUMNS, *more)


def parse_access(lines: DataFrame) -> DataFrame:
    """Every access record of every line; several may share a line (``pos`` counts them)."""
    return typed_access(access_records(found(lines.where(F.col("raw").contains("MEM_")))))


def classify(access: DataFrame) -> DataFrame:
    """Values and category flags of access rows."""
    low = F.lower("descr")
    return access.withColumns({
        "value": hex_decimal(F.col("value_hex")),
        "value_d": hex_double(F.col("value_hex")),
        "value_bits": hex_bits(F.col("value_hex")),
        "is_read": F.col("action") == READ,
        "is_write": F.col("action") == WRITE,
        "is_array": F.col("descr").contains("[") & F.col("descr").contains("]"),
        "is_fsm_related": low.contains("fsm") | low.contains("state"),
        "is_status": low.contains("status") | low.contains("error"),
    })


def stamped(records: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """As-of join: give each mark of ``found`` the last time before it in its run ("0" if none), in one pass for all kinds.

    Of the other lines only ids and the time travel through the shuffle, never the text.
    """
    stops = records.where("bracket is not null").select(
        "test_id", "line_id", F.lit(None).cast(MARK_TYPE[len("array<"):-1]).alias("mark"), F.col("bracket").alias("_ts"), F.lit(1).alias("_o"))
    # Marks sort before the bracket of their own line: it lies behind them, or they own it.
    asks = records.select("test_id", "line_id", F.explode_outer("marks").alias("mark"), F.lit(None).cast("string").alias("_ts"),
                          F.lit(0).alias("_o")).where("mark is not null")
    both, order = asks.unionByName(stops), ["line_id", "_o"]
    earlier = Window.partitionBy("test_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = carry.by_run_size(
        both, lambda runs: runs.withColumn("_seen", F.last("_ts", ignorenulls=True).over(earlier)),
        lambda large: carry.with_last_known(carry.log_chunks(large, chunk_lines), ["test_id"], order, "_ts", "_seen").drop(carry.CHUNK),
        chunk_lines, both.select("test_id")).where("_o = 0")
    return (seen.select("test_id", "line_id", "mark.*", F.coalesce("mark.own", "_seen", F.lit("0")).alias("ts_text"))
            .withColumn("ts_ns", F.expr("try_cast(ts_text as bigint)")))


def _groups(kind: str) -> Column:
    _, pattern, n = MARKS[kind]
    return F.split(F.regexp_replace("raw", pattern, "\n".join(f"${i}" for i in range(1, n + 1))), "\n", n)


def transitions(marks: DataFrame, dedupe_sleep=False) -> DataFrame:
    """State transitions among ``stamped`` marks.  A sleep-state line also reads as a generic one named ``transition``;
    both rows are kept unless ``dedupe_sleep``."""
    rows = marks.where(F.col("kind").isin("sleep", "generic"))
    rows = rows.withColumn("g", F.when(F.col("kind") == "sleep", F.concat(F.array(F.lit(SLEEP_FSM)), _groups("sleep"))).otherwise(_groups("generic")))
    g = F.col("g")
    rows = rows.withColumns({"fsm_name": g[0], "from_state": g[1], "to_state": g[2]})
    if dedupe_sleep:
        rows = rows.where(~((F.col("kind") == "generic") & (F.col("fsm_name") == "transition") & F.col("after_sleep")))
    return rows.select(*FSM_COLUMNS)


def messages(marks: DataFrame) -> DataFrame:
    """Errors among ``stamped`` marks."""
    return marks.where("kind = 'error'").withColumn("message", _groups("error")[0]).select(*ERR_COLUMNS)


def parse_fsm(lines: DataFrame, dedupe_sleep=False, ts_source="nearest",
              chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """State transitions with times (``transitions``), from lines.  ``ts_source='nearest'`` takes the last bracketed
    integer before, array indexes included; ``'record'`` takes only the time of an access record."""
    return transitions(stamped(found(lines, ts_source, kinds=("sleep", "generic")), chunk_lines), dedupe_sleep)


def parse_errors(lines: DataFrame, ts_source="nearest", chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Errors with times, from lines; ``ts_source`` as for ``parse_fsm``."""
    return messages(stamped(found(lines, ts_source, kinds=("error",)), chunk_lines))


def analysis_frame(access: DataFrame, fsm: DataFrame) -> DataFrame:
    """Accesses and standardised transitions in one frame; ``part`` keeps accesses first."""
    steps = fsm.select(
        "test_id", "line_id", "pos", "ts_ns", "ts_text", F.lit(TRANSITION).alias("action"),
        F.concat("fsm_name", F.lit("_transition")).alias("descr"),
        F.concat("from_state", F.lit("->"), "to_state").alias("value_hex"),
        F.when(F.col("kind") == "sleep", 1).otherwise(2).alias("part"))
    return access.withColumn("part", F.lit(0)).unionByName(steps, allowMissingColumns=True)


def array_name(descr: Column) -> Column:
    """The longest run without brackets before an index; '' when there is none."""
    return F.regexp_extract(descr, r"(?U)([^\[\]]+)(?:\[\d+\])+", 1)
