"""Streaming jobs over several files: micro-batches, late order and replays."""

import datetime as dt
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from poolsight.operators import ledger as ops
from poolsight.operators import telemetry
from poolsight.plans import bindings as B
from poolsight.streaming import jobs

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def daily(spark):
    """The events table as one folder of many files, a file per day."""
    path = tempfile.mkdtemp(prefix="run-") + "/events"
    events = B.table(spark, ROOT, "events").withColumn("day", F.to_date("ts"))
    for part, day in enumerate([r.day for r in events.select("day").distinct().orderBy(F.desc("day")).limit(5).collect()]):
        events.filter(F.col("day") == day).drop("day").coalesce(1).write.mode("append").parquet(path)
    return path


def place():
    base = tempfile.mkdtemp(prefix="run-")
    return base + "/out", base + "/checkpoint"


def test_append_in_small_batches_keeps_every_row(spark, daily):
    out, checkpoint = place()
    stream = B.otel_logs(spark, ROOT, jobs.read_events(spark, daily, files_per_trigger=1))
    query = jobs.append_telemetry(stream, None, out, checkpoint, drain=True)
    query.awaitTermination()
    assert len(query.recentProgress) > 1
    assert spark.read.parquet(out).count() == spark.read.parquet(daily).count()


def test_restart_reads_only_new_files(spark, daily):
    out, checkpoint = place()

    def run():
        jobs.append_telemetry(B.otel_logs(spark, ROOT, jobs.read_events(spark, daily)), None, out, checkpoint, True).awaitTermination()

    run()
    first = spark.read.parquet(out).count()
    spark.read.parquet(daily).limit(7).write.mode("append").parquet(daily + "-more")
    run()
    assert spark.read.parquet(out).count() == first


def test_state_fold_over_batches_equals_batch_fold(spark, daily):
    out, checkpoint = place()
    polls = B.run_polls(spark, ROOT, jobs.read_events(spark, daily, files_per_trigger=1))
    jobs.fold_run_states(polls, out, checkpoint, True).awaitTermination()
    want = ops.fold_polls(B.run_polls(spark, ROOT, spark.read.parquet(daily)))
    assert same(jobs.read_run_states(spark, out), want)


def same(got, want):
    return got.count() == want.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def utilisation(events):
    return events.select(
        "ts", F.concat(F.lit("t"), F.col("user_id") % 3).alias("team"), F.floor("value").cast("double").alias("util_pct"),
        F.lit(80).alias("mem_total"), (F.col("event_id") % 50).alias("mem_used"),
    )


def test_windows_of_a_backlog_in_falling_order_are_whole(spark, daily):
    out, checkpoint = place()
    query = jobs.utilization_windows(utilisation(jobs.read_events(spark, daily, 1)), out, checkpoint, drain=True)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 5
    want = telemetry.window_utilization(utilisation(spark.read.parquet(daily)))
    assert same(jobs.read_utilization(spark, out), want)
    assert want.agg(F.sum("samples")).first()[0] == spark.read.parquet(daily).count()


def test_sessions_of_a_backlog_in_falling_order_are_whole(spark, daily):
    out, checkpoint = place()
    beats = jobs.read_events(spark, daily, 1).select(F.col("user_id").alias("run_id"), "ts")
    jobs.detect_silent_runs(beats, out, checkpoint, "9 hours", drain=True).awaitTermination()
    known = spark.range(500).select(F.col("id").alias("run_id"))
    whole = telemetry.beat_sessions(spark.read.parquet(daily).select(F.col("user_id").alias("run_id"), "ts"), "9 hours")
    assert same(jobs.read_silent_runs(spark, out, known, "9 hours"), telemetry.silent_runs(whole, known, "9 hours"))
    assert spark.read.parquet(out + "/parts").count() > whole.count()


def test_generations_are_merged_and_folders_stay_few(spark, daily):
    out, checkpoint = place()
    landed = jobs.read_events(spark, daily, 1).select(F.col("user_id").alias("source"), F.col("ts").alias("sent_at"), F.col("ts").alias("landed_at"))
    jobs.keep_parts(landed, telemetry.landed_counts, telemetry.merge_landed_counts, out, checkpoint, True, every=2).awaitTermination()
    names = lambda folder: sorted(p.name for p in Path(out, folder).iterdir() if p.is_dir())
    assert names("snapshots") == ["generation=0", "generation=1"] and names("parts") == ["generation=1", "generation=2"]
    want = telemetry.landed_counts(spark.read.parquet(daily).select(F.col("user_id").alias("source"), F.col("ts").alias("sent_at"), F.col("ts").alias("landed_at")))
    assert same(jobs.read_deliveries(spark, out), want)


def test_reading_before_any_batch_says_so(spark):
    with pytest.raises(ValueError, match="no batch"):
        jobs.read_run_states(spark, place()[0])


def test_a_stream_without_rows_gives_no_rows(spark):
    out, checkpoint = place()
    path = tempfile.mkdtemp(prefix="run-")
    beats = jobs.read_events(spark, path).select(F.col("user_id").alias("run_id"), "ts")
    jobs.detect_silent_runs(beats, out, checkpoint, drain=True).awaitTermination()
    assert jobs.read_silent_runs(spark, out, spark.range(3).select(F.col("id").alias("run_id"))).collect() == []


def test_audit_stream(spark, daily):
    out, checkpoint = place()
    requests = jobs.read_events(spark, daily).select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("u").alias("requested_by"), F.lit("t").alias("team"),
        F.lit("S").alias("shape"), F.lit(1).alias("nodes"), F.lit("w").alias("name"),
    )
    jobs.append_audit(requests, out, checkpoint, True).awaitTermination()
    row = spark.read.parquet(out).orderBy("time").first()
    assert row.event_name == "run_requested" and row.message.startswith("run ")


def test_silent_runs_close_after_the_gap(spark):
    start = dt.datetime(2026, 1, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    path = tempfile.mkdtemp(prefix="run-") + "/beats"
    for minutes in ([(3, 200), (1, 15)], [(1, 30), (2, 9), (1, 195)], [(1, 0), (1, 5), (2, 0), (2, 18)]):
        spark.createDataFrame([(run, at(m)) for run, m in minutes], "run_id int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("run_id int, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = place()
    active = spark.createDataFrame([(1,), (2,)], "run_id int")
    jobs.detect_silent_runs(stream, out, checkpoint, drain=True).awaitTermination()
    got = {(r.run_id, r.last_event, r.events, r.silent) for r in jobs.read_silent_runs(spark, out, active).collect()}
    assert got == {(1, at(5), 2, True), (1, at(15), 1, True), (1, at(30), 1, True), (1, at(195), 1, False), (2, at(18), 3, True)}


def test_sessions_by_spans_equal_sessions_by_beats(spark):
    """A hot run with beats on the edges of windows, gaps of exactly the limit, repeats and nulls, against one pass in order."""
    start, gap = dt.datetime(2026, 1, 1), dt.timedelta(minutes=10)
    draw = __import__("random").Random(3)
    beats = [(draw.choice([1, 1, 2, None]), start + dt.timedelta(minutes=draw.randrange(0, 4000) // 5 * 5)) for _ in range(500)] + [(1, None), (5, None)]
    expected = []
    for run in (1, 2, None):
        spell = []
        for ts in sorted(t for r, t in beats if r == run and t is not None):
            if spell and ts >= spell[-1] + gap:
                expected.append((run, spell[0], spell[-1], len(spell)))
                spell = []
            spell.append(ts)
        expected.append((run, spell[0], spell[-1], len(spell)))
    sessions = telemetry.beat_sessions(spark.createDataFrame(beats, "run_id int, ts timestamp_ntz"))
    got = [tuple(r) for r in sessions.select("run_id", "first_event", "last_event", "events").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    plan = sessions._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") and "session" not in plan.lower()
