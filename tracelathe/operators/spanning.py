"""Records that span lines.

White space inside a record may be a line end, so a record may begin on one line and go on over the next ones.
Matching line by line would lose it; matching whole texts would put a trace into one row.  Here a line tells by itself
whether its end may be the open part of a record, or its beginning the rest of one.  Such signs are rare: where there
are none, the lines are returned as they are, after one scan.  Otherwise two codes per line travel along the run
(``carry``, so that a seam between chunks is no border), lines that may belong together become
one, and the parser matches it anew.

A border between lines is closed wherever the grammar allows no record to cross it; too many joins do no harm, as
a joined line is matched like a text.  So the records found are those of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelathe.operators import carry
from tracelathe.schema import CHUNK_LINES
from tracelathe.session import materialize

# How the parts of a record (see the grammar in ``parse``) look at the end and at the beginning of a line.
_NAME = r"[\p{L}\p{N}_]+"
_HEX = "0x[0-9a-fA-F]+"
#: Ends after which any text may go on: a size, a comment's arrow, a transition's parts, an error's colon.
ENDS = {"size": r"(?U)(?:^|\]\s+)\s*\d+b\s*$", "arrow": r"(?U)<--\s*$", "to": r"(?U)->\s*$", "error": r"(?U)ERROR\s*:?\s*$|^\s*:\s*$",
        "fsm": rf"(?U)FSM(?:\s+{_NAME}:)?\s*$", "sleep": r"(?U)(?:Sleep|State|transition:)\s*$", "action": r"(?U)MEM_[RW]\s*$"}
#: Beginnings that can only be the rest of a record.
HEADS = {"action": r"(?U)^\s*MEM_[RW](?:\s|$)", "value": rf"(?U)^\s*{_HEX}", "arrow": r"(?U)^\s*<--(?:\s|$)", "to": r"(?U)^\s*->(?:\s|$)",
         "colon": r"(?U)^\s*:", "size": r"(?U)^\s*\d+b(?:\s|$)", "address": rf"(?U)^\s*\[{_HEX}\]"}
#: What must stand before such a beginning.
BEFORE = {"action": r"(?U)\[\d+\]\s*$", "arrow": rf"(?U){_HEX}\s*$", "to": r"(?U)[\p{L}\p{N}_]\s*$", "colon": r"(?U)ERROR\s*$",
          "size": rf"(?U)\[{_HEX}\]\s*$", "address": r"(?U)MEM_[RW]\s*$", "value": r"(?U)(?:^|\]\s+)\s*\d+b\s+\S", "name": rf"(?U)^\s*{_NAME}:\s*$"}


def _plain_end(raw: Column) -> Column:
    """Whether the last letters alone tell that no pattern of ``ENDS`` holds: each ends in one of these and white space."""
    text = F.rtrim(raw)
    open_ = F.substring(text, -1, 1).rlike(r"(?U)\s")
    for last in ("b", "--", "->", ":", "ERROR", "FSM", "Sleep", "State", "MEM_R", "MEM_W"):
        open_ = open_ | text.endswith(last)
    return ~open_


def _code(raw: Column, patterns: dict[str, str]) -> Column:
    return sum((F.when(raw.rlike(p), 1 << k).otherwise(0) for k, p in enumerate(patterns.values())), F.lit(0))


def _has(code: str, patterns: dict[str, str], *names: str) -> Column:
    bits = sum(1 << k for k, name in enumerate(patterns) if name in names)
    return F.col(code).bitwiseAND(F.lit(bits)) != 0


def _crossed() -> Column:
    """Whether a record may cross the border between a line and the one before (codes prev.*, older.*)."""
    after = _has("prev.ends", ENDS, "size", "arrow", "to", "error", "fsm", "sleep", "action")
    met = F.lit(False)
    for name in ("action", "arrow", "to", "colon", "size", "address"):
        met = met | (_has("heads", HEADS, name) & _has("prev.before", BEFORE, name))
    # A value's description is on the line before; its size there, too, or at the end of the one before that.
    value = _has("heads", HEADS, "value") & (_has("prev.before", BEFORE, "value") | _has("older.ends", ENDS, "size"))
    name = _has("prev.before", BEFORE, "name") & _has("older.ends", ENDS, "fsm")
    return F.coalesce(after | met | value | name, F.lit(False))


def signs(raw: Column) -> Column:
    """Whether a line may hold the open part, or the rest, of a record."""
    # Beginnings share one anchor, without which the pattern would be tried at every letter.
    heads = "|".join(p.removeprefix(r"(?U)^\s*") for p in HEADS.values())
    ends = "|".join(f"(?:{p})" for p in ENDS.values())
    return raw.rlike(rf"(?U)^\s*(?:{heads})") | (~_plain_end(raw) & raw.rlike(ends))


def members(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame | None:
    """Lines that may share a record: (test_id, line_id, first: id of the first of them), stored; None without any.

    Worth calling where some line has ``signs``.  A run of lines that may all belong together has one ``first``."""
    raw = F.col("raw")
    codes = (lines.where(raw.rlike(r"(?U)\S")).select("test_id", "line_id", F.when(_plain_end(raw), 0).otherwise(_code(raw, ENDS)).alias("ends"), _code(raw, HEADS).alias("heads"),
                                                        _code(raw, BEFORE).alias("before")))
    codes = materialize(carry.log_chunks(codes, chunk_lines), "line-codes")
    order, cols = ["line_id"], ["ends", "before", "older"]
    with_older = carry.with_previous(codes, ["test_id"], order, ["ends"], out="older")
    seen = carry.with_previous(with_older, ["test_id"], order, cols)
    # Of the line two before only how it ends: that is what the line before knew as its predecessor.
    seen = seen.withColumn("older", F.col("prev.older")).withColumn("_crossed", _crossed())
    seen = materialize(seen.select("test_id", "line_id", carry.CHUNK, "_crossed", F.when(~F.col("_crossed"), F.col("line_id")).alias("_own")), "line-borders")
    if seen.where("_crossed").isEmpty():
        return None
    blocks = carry.with_last_known(seen, ["test_id"], order, "_own", "_first").where("_crossed").select("test_id", "line_id", F.col("_first").alias("first"))
    both = blocks.unionByName(blocks.select("test_id", F.col("first").alias("line_id"), "first").distinct())
    return materialize(both, "spanning")  # its size is known from here on: Spark broadcasts it only if small


def texts(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of ``members`` as texts, under the id of the first, with line feeds between."""
    return (lines.join(found, ["test_id", "line_id"]).groupBy("test_id", "first")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
            .withColumnRenamed("first", "line_id"))


def without(df: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of lines that are not among ``members``."""
    return df.join(found.select("test_id", "line_id"), ["test_id", "line_id"], "left_anti")


def joined(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``lines`` (test_id, line_id, raw) with lines that may share a record as one: under the id of the first, with line
    feeds between.  Blank lines between them are left out of it.

    Reads ``lines`` more than once; store them first if they are costly to make.  A run of lines that may all
    belong together becomes one row, however long."""
    # One scan; nearly every line ends here.
    if lines.where(signs(F.col("raw"))).isEmpty():
        return lines
    found = members(lines, chunk_lines)
    if found is None:
        return lines
    return without(lines, found).select("test_id", "line_id", "raw").unionByName(texts(lines, found))
