"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "poolsight", shared: str | None = None) -> SparkSession:
    """`shared` is the folder for tables and checkpoints where the configuration names none."""
    partitions = cpus if isinstance(cpus, int) else 8
    named = SparkConf().get("spark.checkpoint.dir") or shared
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = (builder.config("spark.checkpoint.dir", named) if named else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
