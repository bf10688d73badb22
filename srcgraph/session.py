"""Session settings and durable intermediate tables."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Rows a frame may have to be broadcast by hand; larger ones take a shuffle join.
BROADCAST_ROWS = 200_000
SPLIT_BYTES = 128 << 20
# Rows that one task sorts or makes distinct; larger tables get more tasks.
TASK_ROWS = 500_000
# Drop the shuffle files of an execution when it ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", shuffle_partitions: str | None = None,
                  memory: str = "12g") -> SparkSession:
    """Session for one machine: tests, bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("srcgraph")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate())


def spread_small(frame: DataFrame) -> DataFrame:
    """Spread a small input over the cores before work that is heavy per row.

    A file with one row group is one task, however much text it holds.  Inputs
    that fill the cores with full-sized splits anyway are left as they are.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return frame.repartition(cores * 2) if int(str(size)) < cores * SPLIT_BYTES else frame


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir``, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="srcgraph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a frame of about ``rows`` rows by its keys over tasks whose number grows with them.

    What follows on the same keys (a window, distinct rows) needs no other shuffle, and a
    task's memory stays the same however large the table is.
    """
    tasks = max(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return frame.repartition(tasks, *keys)


def cut(frame: DataFrame, *metrics, path: str | None = None) -> tuple[DataFrame, dict]:
    """Write the frame to the shared folder, at ``path`` if given, and read it back.

    The table survives the loss of executors, ends the lineage and has exact
    size statistics for the next join.  Returns it with its row count ``n``
    and any further aggregate ``metrics`` of its rows.  What was shuffled for it
    leaves the disks at once, since nothing reads it any more.
    """
    spark = frame.sparkSession
    seen, path = Observation(), path or new_path(spark)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.observe(seen, F.count(F.lit(1)).alias("n"), *metrics).write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path), seen.get


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's own readers see it: one without a scheme lies in Hadoop's default file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
