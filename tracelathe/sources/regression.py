"""A regression directory as DataFrames: one sub-directory per run with a trace and a run log."""

from __future__ import annotations

import os
import re
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelathe.operators import carry
from tracelathe.schema import (FAIL, FAIL_MARK, PASS, RAW_LINES, RUN_LOG_NAME, RUNS, TRACE_NAME,
                               UNKNOWN)
from tracelathe.session import materialize


def _decoded(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _run_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _absolute(root: str) -> str:
    return root if "://" in root or root.startswith("file:") else os.path.abspath(root)


def _glob(root: str, name: str) -> str:
    """Pattern for ``<root>/*/<name>`` with the root's own glob characters taken literally."""
    return f"{re.sub(r'([\\\[\]{}*?])', r'\\\1', _absolute(root)).rstrip('/')}/*/{name}"


def list_runs(spark: SparkSession, root: str, trace=TRACE_NAME, run_log=RUN_LOG_NAME) -> DataFrame:
    """(test_id, path, has_trace, has_log, log_bytes) of the direct sub-directories; empty when there is no root.

    Names are listed through the file systems and credentials that Spark itself reads with, by three
    listings (directories, traces, run logs).  Spark's own file sources skip empty files, which count here.
    """
    base = _absolute(root).rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(base)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = "test_id string, path string, has_trace boolean, has_log boolean, log_bytes long"
    if not system.exists(path):
        return spark.createDataFrame([], schema)

    def named(status) -> str:
        uri = status.getPath().toUri()
        return uri.getPath() if uri.getScheme() in (None, "file") else status.getPath().toString()

    def files(name: str) -> dict[str, int]:
        found = system.globStatus(hadoop.Path(_glob(base, name))) or []
        return {named(f).rsplit("/", 1)[0]: f.getLen() for f in found if f.isFile()}

    dirs = [named(s) for s in system.listStatus(path) if s.isDirectory()]
    traces, logs = files(trace), files(run_log)
    rows = [(d.rsplit("/", 1)[1], d, d in traces, d in logs, logs.get(d, 0)) for d in dirs]
    return spark.createDataFrame(rows, schema)


def _lines(spark: SparkSession, root: str, name: str, whole_text=False) -> DataFrame | None:
    """(uri, split, line_id, raw).  Bytes that are no UTF-8 are dropped; unreadable files are skipped.

    Line ids are local to the task that reads a split and rise within it (gzip does not split: its one split is 0).
    """
    try:
        text = spark.read.option("ignoreCorruptFiles", "true").text(_glob(root, name), wholetext=whole_text)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return text.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line_id"),
                       F.translate("value", "�", "").alias("raw"))


def run_statuses(spark: SparkSession, root: str, listed: DataFrame, run_log=RUN_LOG_NAME) -> DataFrame:
    """(test_id, status) of the listed runs that have a run log: FAIL when any line holds the mark
    in any case.  An empty run log passes; one that holds bytes but gives no line is unreadable: UNKNOWN."""
    present = listed.where("has_log").select("test_id", "log_bytes")
    text = _lines(spark, root, run_log)
    if text is None:
        return present.select("test_id", F.when(F.col("log_bytes") > 0, UNKNOWN).otherwise(PASS).alias("status"))
    log = text.select(_run_of(_decoded(F.col("uri"))).alias("test_id"), "raw")
    seen = log.select("test_id").distinct().withColumn("_seen", F.lit(True))
    return (label_runs(present.select("test_id"), log).join(present, "test_id").join(seen, "test_id", "left")
            .select("test_id", F.when((F.col("log_bytes") > 0) & F.col("_seen").isNull(), UNKNOWN).otherwise(F.col("status")).alias("status")))


def label_runs(listed: DataFrame, run_log: DataFrame) -> DataFrame:
    """PASS or FAIL for the listed runs from their run-log lines (test_id, raw)."""
    failed = (run_log.where(F.lower("raw").contains(FAIL_MARK)).select("test_id").distinct()
              .withColumn("_f", F.lit(True)))
    return listed.join(failed, "test_id", "left").select(
        "test_id", F.when(F.col("_f"), FAIL).otherwise(PASS).alias("status"))


def collect_runs(spark: SparkSession, root: str, trace=TRACE_NAME, run_log=RUN_LOG_NAME) -> DataFrame:
    """The run table; runs without a trace are left out, runs without a run log are UNKNOWN."""
    listed = materialize(list_runs(spark, root, trace, run_log), "listing")
    statuses = run_statuses(spark, root, listed, run_log)
    return (listed.where("has_trace").join(statuses, "test_id", "left").select(
        "test_id", "path", F.concat("path", F.lit(f"/{trace}")).alias("log_path"),
        F.coalesce("status", F.lit(UNKNOWN)).alias("status"))).to(RUNS)


def runs_without_trace(spark: SparkSession, root: str, trace=TRACE_NAME) -> DataFrame:
    """Sub-directories without a trace."""
    return list_runs(spark, root, trace).where("NOT has_trace").select("test_id")


def passing(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == PASS)


def failing(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == FAIL)


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def has_failures(runs: DataFrame) -> bool:
    """Whether there is anything to look into."""
    return not failing(runs).isEmpty()


def unreadable(spark: SparkSession, root: str, trace=TRACE_NAME) -> DataFrame:
    """(test_id) of runs whose trace does not decode to its end.  Each file is streamed in small
    blocks by one task; nothing of it is kept.  Streaming takes a file system that Arrow knows;
    elsewhere read traces with ``check=False``."""
    def decodes(system, path) -> bool:
        with system.open_input_stream(path, compression=None) as f:
            decoder = zlib.decompressobj(31)
            started = False
            while block := f.read(1 << 20):
                started = True
                while block:
                    if decoder.eof:
                        block = block.lstrip(b"\0")
                        if not block:
                            break
                        decoder = zlib.decompressobj(31)
                    decoder.decompress(block)
                    block = decoder.unused_data
            return decoder.eof or not started

    def probe(batches):
        from pyarrow import fs
        for pdf in batches:
            bad = []
            for test_id, path in zip(pdf["test_id"], pdf["path"]):
                system, path = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
                try:
                    ok = decodes(system, f"{path}/{trace}")
                except (OSError, zlib.error):
                    ok = False
                if not ok:
                    bad.append(test_id)
            yield pd.DataFrame({"test_id": bad}, dtype="object")

    files = list_runs(spark, root, trace).where("has_trace").select("test_id", "path")
    return files.mapInPandas(probe, "test_id string")


def _in_one_order(lines: DataFrame) -> DataFrame:
    """Line ids that rise through a whole file, from those of its splits: lines of the splits before are counted."""
    splits = lines.groupBy("test_id", "split").agg(F.min("line_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("test_id").orderBy("split")) - F.col("_n")
    splits = splits.select("test_id", "split", (before - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["test_id", "split"]).withColumn("line_id", F.col("line_id") + F.col("_shift"))


def read_traces(spark: SparkSession, root: str, runs: DataFrame | None = None, trace=TRACE_NAME,
                whole_text=False, check=True, bad: DataFrame | None = None) -> DataFrame:
    """(test_id, line_id, raw) of the traces, written once so that line ids stay as they are.

    ``runs`` restricts the runs read; ``check`` drops files that do not decode to their end as a
    whole (``bad``, test_id, where they are known already); ``whole_text`` takes a file as one text, so that a record may span lines.
    """
    text = _lines(spark, root, trace, whole_text)
    if text is None:
        return spark.createDataFrame([], RAW_LINES)
    keyed = text.select(_run_of(_decoded(F.col("uri"))).alias("test_id"), "split", "line_id", "raw")
    if check:
        if bad is None:
            bad = materialize(unreadable(spark, root, trace), "unreadable")
        keyed = carry.keep_runs(keyed, bad, "left_anti")
    if runs is not None:
        keyed = carry.keep_runs(keyed, runs)
    stored = materialize(keyed.select("test_id", "split", "line_id", "raw"), "raw-lines")
    if not stored.where("split > 0").isEmpty():  # a plain-text trace that Spark has split
        stored = materialize(_in_one_order(stored), "ordered-lines")
    return stored.select("test_id", "line_id", "raw")
