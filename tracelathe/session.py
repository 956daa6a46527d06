"""Session settings and tables written to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app="tracelathe", master=None, shuffle_partitions=None, **conf) -> SparkSession:
    """A session with the settings the operators are written for (AQE incl. skew joins, UTC)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key, value)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of the session, once per application: functions that
    run there name its modules, and a worker need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tracelathe_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tracelathe-code-"), "tracelathe.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tracelathe", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._tracelathe_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="tracelathe-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: lineage ends there, lost
    executors cost nothing, and later readers prune its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A file scan with fewer splits than cores, dealt out evenly before heavy per-row work.
    Large inputs have more splits than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for per-group Python work.  The fixed number keeps Spark from merging small
    partitions by their bytes, where the work lies in the groups."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
