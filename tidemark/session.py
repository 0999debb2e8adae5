"""A local session for tests and benchmarks. On a cluster the caller brings its own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", partitions: str = "8", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        # ordered windows are heavy per byte, so small partitions are worth a task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # do not record the Python call site of every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or the context's checkpoint directory.

    Only a local master may have neither; it gets one new temporary folder per application.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folders.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _own_folders[context.applicationId] = folder
    return folder.rstrip("/")


def materialise(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write df once to the shared folder (a folder for each value of `by`) and read it back.

    For results that several branches of a plan use: they are not computed again, and a lost
    executor costs a re-read and not a re-run. `release` deletes what was written.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-run/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete all tables that `materialise` wrote to the shared folder; whether there were any. Frames that read them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark-run")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
