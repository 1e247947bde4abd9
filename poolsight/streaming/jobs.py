"""Structured Streaming jobs over telemetry and run polls.

State, checkpoints and outputs live under the shared folder, so a lost executor or driver
resumes from the checkpoint. Nothing is kept in driver memory.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from poolsight.operators import ledger, telemetry
from poolsight.sources import schemas, versions

FLUSH_INTERVAL = "10 seconds"
#: Batches folded into one snapshot.
COMPACT_EVERY = 100
#: Order of rows inside a telemetry file.
CLUSTERED_BY = ("time", "service_name")

Fold = Callable[[DataFrame], DataFrame]


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Event files below a folder or glob as a stream, with the declared schema and bounded batches."""
    reader = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_telemetry(
    records: DataFrame, identity: DataFrame | None, out: str, checkpoint: str, drain: bool = False
) -> StreamingQuery:
    """Append records to dated parquet, with the client's identity stamped by a static join.

    `drain` processes what is there and stops; otherwise batches flush every ten seconds.
    """
    stamped = records if identity is None else telemetry.stamp_identity(records, identity)
    dated = stamped.withColumn("date", F.to_date("time"))
    return _started(dated.writeStream.format("parquet").partitionBy("date"), out, checkpoint, drain)


def append_table(
    records: DataFrame, out: str, checkpoint: str, drain: bool = False, every: int = COMPACT_EVERY, target_bytes: int = 256 << 20
) -> StreamingQuery:
    """Append records (with a `time` and a `service_name`) to a table by date that stays readable for good.

    Each batch is one commit, so a reader sees whole batches. After `every` batches the small files of a date
    are packed into sorted files of about `target_bytes`, and what was replaced a day ago is removed: a date
    keeps at most `every` batches' files beside its packed ones. The list of live files remembers the last
    batch of this stream, so a batch that is replayed after a failure is not added twice.
    Read it with `read_table`; a null time lands in a date folder of its own.
    """
    dated = records.withColumn("date", F.to_date("time"))
    versions.create(records.sparkSession, out, dated.schema, "date")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        table = versions.latest(spark, out)
        if number > table.done.get(stream, -1):
            clustered = batch.hint("rebalance", "date").sortWithinPartitions("date", *CLUSTERED_BY)
            versions.append(spark, out, versions.stage(clustered, table), {stream: number})
        if (number + 1) % every == 0:
            versions.compact(spark, out, CLUSTERED_BY, target_bytes)
            versions.clean(spark, out)

    return trigger_of(dated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), drain).start()


def read_table(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all whole batches so far."""
    return versions.read(spark, versions.latest(spark, out))


def fold_run_states(polls: DataFrame, out: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep each run's ledger state current; terminal states are final."""
    return keep_parts(polls, ledger.fold_polls, ledger.merge_folds, out, checkpoint, drain)


def read_run_states(spark: SparkSession, out: str) -> DataFrame:
    """Current state of every run."""
    return ledger.merge_folds(read_parts(spark, out))


def count_deliveries(
    landed: DataFrame, out: str, checkpoint: str, within_s: int = 30, drain: bool = False
) -> StreamingQuery:
    """Rows landed per source; `telemetry.delivery_alerts` compares them with the sender."""
    count = partial(telemetry.landed_counts, within_s=within_s)
    return keep_parts(landed, count, telemetry.merge_landed_counts, out, checkpoint, drain)


def read_deliveries(spark: SparkSession, out: str) -> DataFrame:
    return telemetry.merge_landed_counts(read_parts(spark, out))


def utilization_windows(
    samples: DataFrame, out: str, checkpoint: str, window: str = "1 hour", drain: bool = False
) -> StreamingQuery:
    """Tumbling utilisation per team, kept as counts by value, so late samples of any age count."""
    count = partial(telemetry.utilization_counts, window=window)
    return keep_parts(samples, count, telemetry.merge_utilization_counts, out, checkpoint, drain)


def read_utilization(spark: SparkSession, out: str) -> DataFrame:
    """Every window so far, open ones too."""
    return telemetry.utilization_from_counts(telemetry.merge_utilization_counts(read_parts(spark, out)))


def detect_silent_runs(
    heartbeats: DataFrame, out: str, checkpoint: str, silent_for: str = "10 minutes", drain: bool = False
) -> StreamingQuery:
    """Sessions of heartbeats less than `silent_for` apart, mergeable whatever order files come in."""
    fold = partial(telemetry.beat_sessions, silent_for=silent_for)
    merge = partial(telemetry.merge_sessions, silent_for=silent_for)
    return keep_parts(heartbeats, fold, merge, out, checkpoint, drain)


def read_silent_runs(spark: SparkSession, out: str, active: DataFrame, silent_for: str = "10 minutes") -> DataFrame:
    """Sessions of the active runs; `silent` once no event of any run came for so long after the last."""
    sessions = telemetry.merge_sessions(read_parts(spark, out), silent_for)
    return telemetry.silent_runs(sessions, active, silent_for)


def keep_parts(
    stream: DataFrame, fold: Fold, merge: Fold, out: str, checkpoint: str, drain: bool = False, every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Fold each micro-batch into mergeable rows of its own folder; nothing depends on event time.

    No watermark is set, so no row is ever too late and the stream holds no state. A replayed batch
    overwrites its folder. `every` batches are a generation; when the next one begins, the finished
    one and the snapshot before it are merged into a new snapshot, and what that replaces is removed
    one generation later. A reader sees the newest snapshot and at most two generations of batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        generation = number // every
        if number % every == 0 and generation > 0:
            _snapshot(batch.sparkSession, merge, out, generation - 1)
        fold(batch).write.mode("overwrite").parquet(f"{out}/parts/generation={generation}/batch={number}")

    spark = stream.sparkSession
    if not _generations(spark, f"{out}/parts") and not _generations(spark, f"{out}/snapshots"):
        # a reader finds the columns, and no rows, before the first batch is in
        fold(spark.createDataFrame([], stream.schema)).write.mode("ignore").parquet(f"{out}/parts/generation=0/batch=none")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return trigger_of(writer, drain).start()


def read_parts(spark: SparkSession, out: str, through: int | None = None) -> DataFrame:
    """The newest finished snapshot (of a generation below `through`) and the batches after it."""
    snapshots = [g for g in _generations(spark, f"{out}/snapshots", "_SUCCESS") if through is None or g < through]
    kept = max(snapshots, default=-1)
    later = [g for g in _generations(spark, f"{out}/parts") if g > kept and (through is None or g <= through)]
    paths = [f"{out}/parts/generation={g}/*" for g in later] + [f"{out}/snapshots/generation={kept}"] * (kept >= 0)
    if not paths:
        raise ValueError(f"no batch has been written to {out}")
    return spark.read.parquet(*paths)


def _snapshot(spark: SparkSession, merge: Fold, out: str, generation: int) -> None:
    merged = merge(read_parts(spark, out, through=generation))
    merged.write.mode("overwrite").parquet(f"{out}/snapshots/generation={generation}")
    for replaced in (f"{out}/parts/generation={generation - 1}", f"{out}/snapshots/generation={generation - 2}"):
        fs, path = _place(spark, replaced)
        fs.delete(path, True)


def _generations(spark: SparkSession, folder: str, marker: str = "") -> list[int]:
    fs, path = _place(spark, folder)
    if not fs.exists(path):
        return []
    found = [status.getPath() for status in fs.listStatus(path)]
    whole = [p for p in found if not marker or fs.exists(_place(spark, f"{p.toString()}/{marker}")[1])]
    return [int(p.getName().split("=")[1]) for p in whole]


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def append_audit(requests: DataFrame, out: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """The hub's own submissions, appended beside the workloads' telemetry."""
    return append_telemetry(telemetry.audit_events(requests), None, out, checkpoint, drain)


def _started(writer, out: str, checkpoint: str, drain: bool) -> StreamingQuery:
    return trigger_of(writer.option("checkpointLocation", checkpoint).option("path", out), drain).start()


def trigger_of(writer, drain: bool, every: str | None = None):
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every or FLUSH_INTERVAL)
