"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new temporary folder serves a local session; on a cluster it has to be set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="memloom-")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder, so it is worked out once and lost executors don't matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
