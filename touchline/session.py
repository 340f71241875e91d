"""Where jobs keep tables that must outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_MOUNT_KEY = "spark.touchline.sharedFiles"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; a cluster without it is an error, because a
    folder of one machine would be lost with that machine. So is a ``file:`` folder on a cluster, unless
    ``spark.touchline.sharedFiles`` says that it is a mount which all machines share.
    """
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_KEY, None) or context.getConf().get(_CHECKPOINT_KEY) or context.getCheckpointDir()
    local = context.master.startswith("local")
    if named:
        if not local and named.startswith("file:") and spark.conf.get(_MOUNT_KEY, "false") != "true":
            raise RuntimeError(f"{_CHECKPOINT_KEY} is {named}: name a folder shared by all executors, or set {_MOUNT_KEY} if this one is")
    elif local:
        named = tempfile.mkdtemp(prefix="touchline-")
    else:
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: later reads prune columns, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
