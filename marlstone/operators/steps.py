"""Steps whose rows must not change when they are computed again, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names.

    A session of one process without that setting takes a temporary folder; on a cluster that raises, as executors would
    write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df with its rows fixed: checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    folder = shared_path(df.sparkSession, "settled")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there, so that several readers do not compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
