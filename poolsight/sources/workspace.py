"""Where jobs may put tables, checkpoints and stream state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for a local session without it.

    The setting is only read: it belongs to the cluster, and Spark does not let it change later.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder all executors share")
    return f"{tempfile.gettempdir()}/poolsight-{os.getpid()}"


def session_path(spark: SparkSession) -> str:
    """Everything this application writes for itself lies below this folder."""
    return f"{shared_root(spark)}/poolsight/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return f"{session_path(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this application wrote for itself; call it when its results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_path(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
