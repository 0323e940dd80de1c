"""Session set-up and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster the launcher's own settings apply."""
    builder = (
        SparkSession.builder.master(master)
        .appName("devicelog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # The call site of every column expression is only of use in a notebook.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Device clocks carry no zone; UTC keeps every naive value as written."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most ``BATCH_BYTES`` where a session has Spark's default: a batch of whole
    texts is held several times, by the JVM outside its heap and by the worker."""
    if spark.conf.get(_BATCH_LIMIT) == "67108864b":
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def few_listing_tasks(spark: SparkSession) -> None:
    """Folders are listed by eight tasks a core where a session has Spark's default, a task for each of up to 10,000
    folders or named files: the driver takes longer to start a task than the task to list a folder."""
    if spark.conf.get(_LISTING_TASKS) == "10000":
        spark.conf.set(_LISTING_TASKS, str(min(10_000, 8 * spark.sparkContext.defaultParallelism)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's checkpoint folder.

    Only a local session without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/devicelog-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Unlike a cached frame it survives the loss of executors without being
    computed again, and readers still prune its columns.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
