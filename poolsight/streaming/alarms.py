"""Alarms that a stream raises by itself, and takes back.

Runs that fall silent are told by timers in the state of each run, so an alarm needs no further event of
any run. Records that never land are told by an outer join of two streams, the senders' and the sink's:
the unmatched row comes out once stream time has passed the time a record may take.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from poolsight.streaming.jobs import trigger_of

SILENT, BACK = "silent", "back"
STATE = "last_event timestamp, beats long, raised boolean, n long"
ALARMS = [
    T.StructField("last_event", T.TimestampType()), T.StructField("beats", T.LongType()), T.StructField("state", T.StringType()), T.StructField("n", T.LongType()),
]


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a run and batch of rows, so that a run with most of the beats is a few rows when it is dealt out."""
    for batch in batches:
        yield batch.groupby("run_id", dropna=False, as_index=False).agg(ts=("ts", "max"), beats=("ts", "size"))


def run_alarms(beats: DataFrame, silent_for_s: float = 600, forget_after_s: float = 7 * 86400, now: pd.Timestamp | None = None) -> DataFrame:
    """A row whenever a run falls silent and whenever it comes back, numbered per run by `n`.

    A run is silent once `silent_for_s` seconds have passed since its latest event: by the clock, through a
    timer that needs no new data, or at the fixed time `now` where a backlog is drained. Beats may come in any
    order; one older than the latest changes nothing, one that is newer but still too old renews the
    alarm with its time. A silent run's state is forgotten after `forget_after_s` more seconds; a null run is
    a run, a null time is no beat.
    """
    silent, forget = pd.Timedelta(seconds=silent_for_s), int(forget_after_s * 1000)
    run_type = beats.schema["run_id"]

    def follow(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, raised, n = state.get if state.exists else (None, 0, False, 0)
        last = None if last is None else pd.Timestamp(last)
        if state.hasTimedOut:
            if raised:
                state.remove()
                return
            raised, told = True, SILENT
        else:
            before = last
            for part in parts:
                seen += int(part["beats"].sum())
                newest = part["ts"].max()
                last = newest if last is None or newest > last else last
            clock = now if now is not None else pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
            late = last + silent <= clock
            told = SILENT if late and (not raised or last != before) else BACK if raised and not late else None
            raised = late
        n += told is not None
        state.update((last.to_pydatetime(), seen, raised, n))
        if now is None:
            state.setTimeoutDuration(forget if raised else max(1, int((last + silent - clock).total_seconds() * 1000)))
        if told:
            yield pd.DataFrame({"run_id": [key[0]], "last_event": [last], "beats": [seen], "state": [told], "n": [n]})

    known = beats.select("run_id", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts").isNotNull())
    fewer = known.mapInPandas(_newest, T.StructType([run_type, T.StructField("ts", T.TimestampType()), T.StructField("beats", T.LongType())]))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if now is None else GroupStateTimeout.NoTimeout
    return fewer.groupBy("run_id").applyInPandasWithState(follow, T.StructType([run_type, *ALARMS]), STATE, "append", timeout)


def missing_records(
    sent: DataFrame, landed: DataFrame, within_s: int = 30, unordered: str = "10 minutes"
) -> DataFrame:
    """Records of `sent` (source, record_id, sent_at) that `landed` (source, record_id, landed_at) lacks in time.

    Both are streams. A record is missing if it has not landed within `within_s` seconds; its row comes out
    when the time of both streams has passed that bound. Rows may come up to `unordered` late in either;
    state is kept for no longer than both together. A record that lands twice is found once or more, and is
    not missing. Null sources and ids match nothing, so such sent rows are told as missing.
    """
    left = sent.select("source", "record_id", "sent_at").withWatermark("sent_at", unordered)
    right = landed.select(F.col("source").alias("_source"), F.col("record_id").alias("_record"), "landed_at").withWatermark("landed_at", unordered)
    in_time = F.expr(f"_source = source AND _record = record_id AND landed_at >= sent_at AND landed_at <= sent_at + INTERVAL {within_s} SECONDS")
    return left.join(right, in_time, "left_outer").filter(F.col("_record").isNull()).select("source", "record_id", "sent_at")


def write_alarms(alarms: DataFrame, out: str, checkpoint: str, drain: bool = False, every: str | None = None) -> StreamingQuery:
    """Append alarms to a table as they are raised; a restart goes on with the state and its timers."""
    writer = alarms.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return trigger_of(writer, drain, every).start()


def read_run_alarms(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The latest word on every run that an alarm was raised for; no rows before the first batch."""
    latest = F.max_by(F.struct("last_event", "beats", "state"), "n").alias("x")
    return spark.read.schema(schema).parquet(out).groupBy("run_id").agg(latest).select("run_id", "x.*")
