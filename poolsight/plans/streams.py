"""Streaming jobs, drained over the events table read as a stream, and read back from their sink."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from poolsight.operators import telemetry as ops
from poolsight.plans import bindings as B
from poolsight.plans.ledger import FOLDED
from poolsight.plans.registry import query
from poolsight.plans.telemetry import STAMPED, UTIL, stamped_events, utilization
from poolsight.sources import workspace
from poolsight.streaming import alarms, identity, jobs


def events_stream(spark, root):
    # A stream starts from a folder or a glob; this glob fits a table that is one file or a folder.
    return jobs.read_events(spark, f"{root}/events.{{parquet}}")


def paths(spark, name):
    return workspace.fresh_path(spark, name), workspace.fresh_path(spark, f"{name}-checkpoint")


@query(
    "stream_telemetry_append",
    """SELECT CAST(event_id AS VARCHAR) AS record_id, time, CAST(time AS DATE) AS date, service_name, severity_text, mlflow_run_id FROM otel_logs""",
)
def stream_telemetry_append(spark, root):
    """Batches are commits of a dated table, packed and clustered after each; the variant columns come back from it."""
    out, checkpoint = paths(spark, "stream-logs")
    jobs.append_table(B.otel_logs(spark, root, events_stream(spark, root)), out, checkpoint, True, every=1).awaitTermination()
    return jobs.read_table(spark, out).select(
        "record_id", "time", "date", "service_name", "severity_text",
        ops.attribute("resource.attributes", ops.RUN_KEY).alias("mlflow_run_id"),
    )


@query(
    "stream_metrics_append",
    """SELECT CAST(ts AS DATE) AS date, 'run-' || CAST(user_id % 20 AS VARCHAR) AS mlflow_run_id, COUNT(*) * 7 AS readings, CAST(SUM(event_id) AS BIGINT) AS steps
  FROM events GROUP BY 1, 2""",
)
def stream_metrics_append(spark, root):
    """The metric stream lands in a dated table of its own; readings and steps per day and run."""
    out, checkpoint = paths(spark, "stream-metrics")
    jobs.append_telemetry(B.otel_metrics(spark, root, events_stream(spark, root)), None, out, checkpoint, True).awaitTermination()
    run = ops.attribute("resource.attributes", ops.RUN_KEY).alias("mlflow_run_id")
    steps = F.sum(F.when(F.col("name") == ops.STEPS, F.col("value").cast("bigint")))
    return spark.read.parquet(out).groupBy("date", run).agg(F.count(F.lit(1)).alias("readings"), steps.cast("bigint").alias("steps"))


@query(
    "stream_baggage_stamp",
    """SELECT event_id, user_id AS run_id, COALESCE(CASE WHEN event_id % 4 = 0 THEN 'self' END, c_name) AS requester,
  'team-' || CAST(c_nationkey AS VARCHAR) AS team FROM events LEFT JOIN customer ON c_custkey = user_id""",
)
def stream_baggage_stamp(spark, root):
    out, checkpoint = paths(spark, "stream-stamped")
    own = F.when(F.col("event_id") % 4 == 0, "self")
    records = events_stream(spark, root).select(
        "event_id", F.col("ts").alias("time"), F.col("user_id").alias("run_id"), own.alias("requester")
    )
    identity = B.table(spark, root, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.col("c_name").alias("requester"),
        B.text("team-", F.col("c_nationkey")).alias("team"),
    )
    jobs.append_telemetry(records, identity, out, checkpoint, True).awaitTermination()
    return spark.read.parquet(out).select("event_id", "run_id", "requester", "team")


@query("stream_identity_versions", STAMPED)
def stream_identity_versions(spark, root):
    """Records and identity changes are both streams; each record has the identity of its own time."""
    out, checkpoint = paths(spark, "stream-versions")
    records, told = stamped_events(events_stream(spark, root))
    identity.stamp_versions(records, told, out, checkpoint, drain=True).awaitTermination()
    return identity.read_stamped(spark, out).select("event_id", "run_id", "requester", "team")


@query("stream_run_state_fold", FOLDED)
def stream_run_state_fold(spark, root):
    out, checkpoint = paths(spark, "stream-states")
    polls = B.run_polls(spark, root, events_stream(spark, root))
    jobs.fold_run_states(polls, out, checkpoint, True).awaitTermination()
    return jobs.read_run_states(spark, out).drop("settled_seq")


@query(
    "stream_delivery_check",
    """SELECT source, COUNT(*) + CASE WHEN source % 10 = 0 THEN 1 ELSE 0 END AS expected, COUNT(*) AS landed,
  COUNT(*) FILTER (WHERE value <= 300) AS on_time, COUNT(*) FILTER (WHERE value <= 300) < COUNT(*) + CASE WHEN source % 10 = 0 THEN 1 ELSE 0 END AS alert
  FROM (SELECT user_id AS source, value FROM events) GROUP BY source""",
)
def stream_delivery_check(spark, root):
    """Rows land value/10 seconds after they were sent; every tenth sender lost one more row."""
    out, checkpoint = paths(spark, "stream-delivery")
    delay = F.make_dt_interval(secs=(F.col("value") / 10).cast("decimal(18,6)"))
    landed = events_stream(spark, root).select(
        F.col("user_id").alias("source"), F.col("ts").alias("sent_at"), (F.col("ts") + delay).alias("landed_at")
    )
    jobs.count_deliveries(landed, out, checkpoint, drain=True).awaitTermination()
    lost = F.when(F.col("user_id") % 10 == 0, 1).otherwise(0)
    sent = (
        B.table(spark, root, "events")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("user_id").alias("source"), (F.col("n") + lost).alias("expected"))
    )
    return ops.delivery_alerts(jobs.read_deliveries(spark, out), sent)


@query(
    "stream_util_windows",
    f"""SELECT team, date_trunc('hour', ts) AS window_start, AVG(util_pct) AS avg_util, quantile_disc(util_pct, 0.95) AS p95_util,
  MIN(mem_total - mem_used) AS min_mem_headroom, COUNT(*) AS samples FROM ({UTIL}) GROUP BY 1, 2""",
)
def stream_util_windows(spark, root):
    out, checkpoint = paths(spark, "stream-util")
    samples = utilization(spark, root, events_stream(spark, root))
    jobs.utilization_windows(samples, out, checkpoint, drain=True).awaitTermination()
    return jobs.read_utilization(spark, out)


@query(
    "stream_run_health",
    """WITH beats AS (SELECT user_id AS run_id, ts, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM events),
  sessions AS (SELECT run_id, ts, SUM(opens) OVER (PARTITION BY run_id ORDER BY ts) AS n FROM beats),
  closed AS (SELECT run_id, MAX(ts) AS last_event, COUNT(*) AS events FROM sessions GROUP BY run_id, n)
SELECT run_id, last_event, events, name, last_event + INTERVAL 2 HOUR <= (SELECT MAX(ts) FROM events) AS silent
FROM closed JOIN (SELECT c_custkey AS run_id, c_name AS name FROM customer) USING (run_id)""",
)
def stream_run_health(spark, root):
    """Every spell of events of a known run, and whether two silent hours followed."""
    out, checkpoint = paths(spark, "stream-health")
    beats = events_stream(spark, root).select(F.col("user_id").alias("run_id"), "ts")
    known = B.table(spark, root, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    jobs.detect_silent_runs(beats, out, checkpoint, "2 hours", drain=True).awaitTermination()
    return jobs.read_silent_runs(spark, out, known, "2 hours")


@query(
    "stream_stale_alarms",
    """SELECT user_id AS run_id, MAX(ts) AS last_event, COUNT(*) AS beats, 'silent' AS state FROM events
  GROUP BY 1 HAVING MAX(ts) + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-30 18:00:00'""",
)
def stream_stale_alarms(spark, root):
    """Runs whose alarm stands after the events are drained: silent for six hours at a fixed time."""
    out, checkpoint = paths(spark, "stream-alarms")
    beats = events_stream(spark, root).select(F.col("user_id").alias("run_id"), "ts")
    raised = alarms.run_alarms(beats, 6 * 3600, now=pd.Timestamp("2024-01-30 18:00:00"))
    alarms.write_alarms(raised, out, checkpoint, drain=True).awaitTermination()
    standing = alarms.read_run_alarms(spark, out, raised.schema).filter(F.col("state") == alarms.SILENT)
    return standing.withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


@query(
    "stream_missing_records",
    """WITH sent AS (SELECT user_id AS source, event_id AS record_id, ts AS sent_at, ts + to_milliseconds(CAST(floor(value * 100) AS INTEGER)) AS landed_at, event_id % 40 = 7 AS lost FROM events),
  passed AS (SELECT least(max(sent_at), max(landed_at) FILTER (WHERE NOT lost)) - INTERVAL 10 MINUTE - INTERVAL 30 SECOND AS t FROM sent)
SELECT source, record_id, sent_at FROM sent, passed WHERE (lost OR landed_at > sent_at + INTERVAL 30 SECOND) AND sent_at < t""",
)
def stream_missing_records(spark, root):
    """Every fortieth record is lost and the rest land value/10 seconds after they were sent; both sides are streams."""
    out, checkpoint = paths(spark, "stream-missing")
    delay = F.make_dt_interval(secs=(F.floor(F.col("value") * 100) / 1000).cast("decimal(18,6)"))
    sent = events_stream(spark, root).select(F.col("user_id").alias("source"), F.col("event_id").alias("record_id"), F.col("ts").cast("timestamp").alias("sent_at"))
    landed = events_stream(spark, root).filter("event_id % 40 <> 7").select(
        F.col("user_id").alias("source"), F.col("event_id").alias("record_id"), (F.col("ts") + delay).cast("timestamp").alias("landed_at")
    )
    missing = alarms.missing_records(sent, landed)
    alarms.write_alarms(missing, out, checkpoint, drain=True).awaitTermination()
    return spark.read.schema(missing.schema).parquet(out).withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))
