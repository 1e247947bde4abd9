"""Alarms raised by streams: by timers without data, after restarts, for late rows, and for records that never land."""

import datetime as dt
import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from poolsight.streaming import alarms

START = dt.datetime(2026, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def add(spark, path, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(path)


def folders():
    base = tempfile.mkdtemp(prefix="run-")
    return base + "/in", base + "/out", base + "/checkpoint"


BEATS = "run_id string, ts timestamp_ntz"


def stream(spark, path, columns):
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, source, out, checkpoint, now):
    raised = alarms.run_alarms(stream(spark, source, BEATS), 600, now=pd.Timestamp(now))
    alarms.write_alarms(raised, out, checkpoint, drain=True).awaitTermination()
    return raised.schema


def test_alarms_are_raised_and_withdrawn_over_batches_and_restarts(spark):
    """Files come one a batch and out of order; after each drain the standing alarms are those of all beats so far."""
    source, out, checkpoint = folders()
    files = [[("a", at(5)), ("b", at(58)), (None, at(1))], [("a", at(55)), ("c", at(0)), ("a", None)], [("a", at(2)), ("b", at(70))], [("c", at(40)), ("d", at(10))], [("c", at(59))]]
    beats = {}
    for number, rows in enumerate(files):
        add(spark, source, rows, BEATS)
        schema = drained(spark, source, out, checkpoint, at(60))
        for run, t in rows:
            if t is not None:
                beats.setdefault(run, []).append(t)
        words = {r["run_id"]: r for r in alarms.read_run_alarms(spark, out, schema).collect()}
        silent = {run for run, r in words.items() if r["state"] == alarms.SILENT}
        assert silent == {run for run, ts in beats.items() if max(ts) + dt.timedelta(minutes=10) <= at(60)}, number
        assert all(words[run]["last_event"] == max(beats[run]) for run in silent)
    told = [(r["run_id"], r["state"]) for r in spark.read.schema(schema).parquet(out).orderBy("n").collect()]
    assert [s for run, s in told if run == "a"] == ["silent", "back"]
    assert [s for run, s in told if run == "c"] == ["silent", "silent", "back"]


def test_no_rows_before_the_first_alarm(spark):
    source, out, checkpoint = folders()
    add(spark, source, [("a", at(59))], BEATS)
    schema = drained(spark, source, out, checkpoint, at(60))
    assert alarms.read_run_alarms(spark, out, schema).collect() == []


def wait_for(check, seconds=60):
    until = time.time() + seconds
    while time.time() < until:
        if check():
            return True
        time.sleep(0.5)
    return False


def test_a_timer_speaks_without_new_data_also_after_a_restart(spark):
    source, out, checkpoint = folders()
    utc = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    add(spark, source, [("a", utc()), ("b", utc() + dt.timedelta(seconds=25))], BEATS)
    raised = alarms.run_alarms(stream(spark, source, BEATS), 6, forget_after_s=3600)

    def states(run):
        try:
            rows = spark.read.schema(raised.schema).parquet(out).filter(F.col("run_id") == run).orderBy("n").collect()
        except Exception:
            return []
        return [r["state"] for r in rows]

    query = alarms.write_alarms(raised, out, checkpoint, every="1 second")
    try:
        assert wait_for(lambda: states("a") == ["silent"])
    finally:
        query.stop()
        query.awaitTermination(30)
    assert states("b") == []
    add(spark, source, [("a", utc() + dt.timedelta(seconds=3600))], BEATS)
    query = alarms.write_alarms(alarms.run_alarms(stream(spark, source, BEATS), 6, forget_after_s=3600), out, checkpoint, every="1 second")
    try:
        assert wait_for(lambda: states("a") == ["silent", "back"] and states("b") == ["silent"])
    finally:
        query.stop()
        query.awaitTermination(30)


SENT, LANDED = "source string, record_id long, sent_at timestamp", "source string, record_id long, landed_at timestamp"


@pytest.mark.parametrize("restart", [False, True])
def test_missing_records_come_out_as_stream_time_passes(spark, restart):
    base, (_, out, checkpoint) = tempfile.mkdtemp(prefix="run-"), folders()
    second = lambda s: START + dt.timedelta(seconds=s)
    step = [
        ([("s", 1, second(0)), ("s", 2, second(1)), ("t", 1, second(2)), (None, 9, second(2))], [("s", 1, second(5)), ("t", 1, second(50))]),
        ([("s", 3, second(100))], [("s", 3, second(101)), ("s", 3, second(102))]),
        ([("s", 4, second(60)), ("s", 5, second(300))], [("s", 4, second(61)), ("s", 5, second(301))]),
        ([("s", 6, second(400))], [("x", 1, second(400))]),
    ]
    seen = []
    for sent, landed in step:
        add(spark, base + "/sent", sent, SENT)
        add(spark, base + "/landed", landed, LANDED)
        missing = alarms.missing_records(stream(spark, base + "/sent", SENT), stream(spark, base + "/landed", LANDED), 30, "60 seconds")
        alarms.write_alarms(missing, out, checkpoint, drain=True).awaitTermination()
        if not restart:
            continue
        seen.append(sorted((r["source"] or "", r["record_id"]) for r in spark.read.schema(missing.schema).parquet(out).collect()))
    got = sorted((r["source"] or "", r["record_id"]) for r in spark.read.schema(missing.schema).parquet(out).collect())
    # lost, landed too late, without a source; number 6 is still within its time
    assert got == [("", 9), ("s", 2), ("t", 1)]
    if restart:
        assert seen[0] == [] and seen[-1] == got
