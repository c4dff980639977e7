"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several round trips per Column, which the long HTML expressions would pay thousands of times.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "corpusmill", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by `spark.checkpoint.dir`. A temporary one serves local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Removes the shuffle files of a query as soon as it ends. Without it they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Seconds between two collections that staged tables ask of the driver.
COLLECTION_SECONDS = 10
_collected = time.monotonic()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and gives the optimizer the true size of the table, so it
    broadcasts only what is below its threshold. Nothing reads the shuffles of a staged table again, so they go with the write.
    """
    return staged(df, name)[0]


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `stage`, with the path, so that a superseded table can be removed by `drop_staged`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    _collect(spark)
    return spark.read.schema(df.schema).parquet(path), path


def _collect(spark: SparkSession) -> None:
    """Let the driver drop what the steps before have left: Spark removes broadcast tables, 16 MB at least on the driver and each executor,
    only when the driver collects its garbage, which by itself it does after its heap has grown to the limit."""
    global _collected
    if time.monotonic() - _collected >= COLLECTION_SECONDS:
        spark._jvm.System.gc()
        _collected = time.monotonic()


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove a table written by `staged`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that arrives in few pieces, such as one file with one row group, before costly row-local
    work. A scan that already has a partition per core, as any large one does, is returned as it is; a plan with a shuffle is
    left alone, since asking for its partitions would run it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1 or any(word in plan.toString() for word in ("Aggregate", "Join", "Sort", "Repartition", "Distinct", "Deduplicate")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
