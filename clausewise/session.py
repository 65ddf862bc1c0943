"""Session construction and table access.

The cluster owns `spark.checkpoint.dir`; we only set one when the session has
none (tests, local benchmarks), and then in a fresh scratch folder.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clausewise") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Arrow batches to Python UDFs: bounded rows (documents can be long)
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local session (tests, benches) without one gets a fresh scratch
    folder; on a cluster a machine-local folder would be lost to the other
    executors, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_scratch(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def local_scratch(master: str) -> str:
    """A fresh folder of this machine, for `local[...]` masters only."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="clausewise-ckpt-")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once: written as parquet in the shared checkpoint folder
    and read back.  Survives lost executors; the planner knows its size."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session's setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# Tables whose rows carry heavy per-row work (text scans, vector math).
ROW_HEAVY_TABLES = {"documents", "pages", "conversations", "customer", "embeddings", "benchmark"}


#: Set to "true" by the local bench only; plans read tables as they are stored.
SPREAD_CONF = "spark.clausewise.spreadSmallTables"


def spread(df: DataFrame) -> DataFrame:
    """Give row-heavy work at least one partition per core.

    A small table stored as one parquet row group is scanned by a single
    task, which then runs every per-document regex alone.  When the scan
    yields fewer partitions than the default parallelism, rows are dealt
    round-robin over that many partitions (one shuffle of the input).  Meant
    for single-machine benches over single-row-group files."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


#: Input rows of one task where each row is heavy work (a document made and audited: about a millisecond).
HEAVY_ROWS = 4000


def dealt(df: DataFrame, rows: int = HEAVY_ROWS, by: str | None = None) -> DataFrame:
    """Rows with heavy work behind them, dealt round-robin (or by the values of `by`) so
    that a task has about `rows` of them: a file of few row groups is otherwise read, and worked
    through, by as few tasks however long it grows.  Counting reads file footers only."""
    n = math.ceil(df.count() / rows)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, *([by] if by else []))


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (a parquet file or folder of any shared store)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in ROW_HEAVY_TABLES and spark.conf.get(SPREAD_CONF, "false") == "true":
        return spread(df)
    return df
