"""Writing tables down once, so that several passes see the same rows and a lost executor costs no recomputation."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders written by `materialize`, by application, until they are cleared.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or a scratch folder in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    current = context.getCheckpointDir()
    if current:
        return current
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-checkpoints-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path below the shared folder that nothing uses yet; `clear_materialized` deletes what is written there."""
    path = f"{shared_folder(spark).rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet below the shared folder now and continue from the written copy.

    The rows come back in the layout they were written in, possibly in other partitions. The files stay until
    `release` or `clear_materialized`, as the result may be read at any later time.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    written = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    written._lexloom_path = path
    return written


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files behind a frame that `materialize` returned; nothing may read it afterwards."""
    path = getattr(df, "_lexloom_path", None)
    paths = _written.get(df.sparkSession.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)
        _delete(df.sparkSession, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which executors delete the shuffle files of plans that nothing refers to.

    Spark does so every half hour by itself, too late for a job that shuffles much in several steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_materialized(spark: SparkSession) -> int:
    """Delete everything `materialize` has written in this application; returns the number of folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
