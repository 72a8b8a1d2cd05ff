"""Session helpers: settings every job relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("worklore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch.  Spark bounds batches by rows; long texts would make batches of any size, held outside the heap and again in the Python worker.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the zone, all times in the tables are UTC, and bound Arrow batches by their bytes."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) != str(BATCH_BYTES):
        spark.conf.set(bound, str(BATCH_BYTES))
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a session that names none (a local test) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="worklore-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one run under the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: reused results survive a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Write tables of the same columns one after another and read them back as one: a small plan for each, not a large one for their union."""
    path = first = None
    for df in parts:
        if first is None:
            first, path = df, fresh_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over all cores before heavy work per row.

    A scan makes one task per row group; a small table in one file would be
    worked on by one core.  Inputs with a block or more per core have enough
    tasks and are left as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    block = 128 * 1024 * 1024
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * block:
        return df
    return df.repartition(cores, *keys)
