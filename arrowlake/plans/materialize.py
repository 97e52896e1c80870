"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder set on its context; a temporary one on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: the files outlive any executor, so later stages survive losing one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    release_shuffles(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: one job, and a table whose size the planner
    knows, so that rounds over small tables need no shuffle and those over large ones still do."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work now.

    Its cleaner acts on what the driver's collector finds unreachable, which for a small driver may be hours
    after a stage is over; between the phases of a long job that keeps several times the input on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
