"""Files and tables in the folder that all executors share.

The folder is the one `spark.checkpoint.dir` names. Tables go through Spark. Formats Spark has no
writer for (WARC, flat token files) go through `pyarrow.fs`, which resolves the folder's own URI
scheme on whichever machine the task runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsight.sources import workspace

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses, in the application's workspace, so `workspace.clear` removes it with the rest."""
    return workspace.fresh_path(spark, f"llm/{name}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: it cuts lineage and outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Jobs run inside send at most so many rows to Python together; the caller's setting comes back after."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path inside it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def move_staged(files: DataFrame, folder: str, staging: str) -> int:
    """Give each (staged, name) file of `folder/staging` its final name in `folder`, in tasks; returns how many.

    A task that is run again finds its files moved already and goes on; a file in neither place is an error.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = filesystem(folder)
        for batch in batches:
            for staged, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, target = f"{base}/{staging}/{staged}", f"{base}/{name}"
                there = here.get_file_info([source, target])
                if there[0].type != fs.FileType.NotFound:
                    here.move(source, target)
                elif there[1].type == fs.FileType.NotFound:
                    raise FileNotFoundError(source)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = files.select("staged", "name").repartition(spread, "name").mapInArrow(move, "n long")
    return moved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
