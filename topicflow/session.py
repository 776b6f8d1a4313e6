"""Session settings and the shared folder that holds stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "topicflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings win over ours when given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, reachable from every executor.

    Only a local session may fall back to a folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="topicflow-"))
    return context.getCheckpointDir().rstrip("/")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Place a scan of few splits on all cores; larger scans stay as they are read.

    The rows are dealt by a hash of the key, which is no partitioning by the key to the planner:
    later operators get the plan that they get on a large table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.xxhash64(key))


# of the rows that a Python worker holds at once
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, so that a worker's memory does not follow the
    length of the texts; the default, 64 MB, is much for several workers in one executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write ends; what it made is a table by then."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, *partition_by: str, name: str = "stage") -> DataFrame:
    """Write ``df`` as a stage table and read it back: cuts lineage, survives executor loss.

    The table is columnar, so later readers prune columns, and partitions given by
    ``partition_by`` are pruned by filters on those columns.
    """
    return materialize_parts([df], *partition_by, name=name)


def materialize_parts(parts: Iterable[DataFrame], *partition_by: str, name: str = "stage") -> DataFrame:
    """``materialize`` for parts of one schema that are written one after the other, so that only one
    part's shuffle is on disk at a time."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or new_path(spark, name)
        with short_shuffles(spark):
            df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def discard(*tables: DataFrame) -> None:
    """Empty the stage tables that the given ones read; for what is contained in a later stage table."""
    for df in tables:
        spark = df.sparkSession
        folder = re.compile(rf"^(.*/[^/]+-[0-9a-f]{{32}})/")
        none = spark.createDataFrame([], "dropped boolean")
        for path in {m[1] for m in map(folder.match, df.inputFiles()) if m}:
            none.write.mode("overwrite").parquet(path)
