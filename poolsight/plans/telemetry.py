"""Family C queries: telemetry, identity and the specified panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolsight.functions import ledger as L
from poolsight.functions import text as T
from poolsight.operators import telemetry as ops
from poolsight.operators import usage as usage_ops
from poolsight.plans import bindings as B
from poolsight.plans.registry import query
from poolsight.plans.usage import BY_TEAM, by_team
from poolsight.sources import schemas, sinks, workspace

SUMMARY = "SELECT mlflow_run_id, COUNT(*) AS log_rows, MIN(time) AS first_event, MAX(time) AS last_event FROM otel_logs GROUP BY 1"


@query(
    "scan_timeline",
    """SELECT run_id, param_a, param_b, run_as, period_start_time, result_state FROM timeline""",
)
def scan_timeline(spark, root):
    return B.timeline(spark, root).select(
        "run_id",
        F.col("job_parameters")["a"].alias("param_a"),
        F.col("job_parameters")["b"].alias("param_b"),
        "identity_metadata.run_as",
        "period_start_time",
        "result_state",
    )


@query(
    "scan_otel_logs",
    """SELECT CAST(event_id AS VARCHAR) AS record_id, time, CAST(time AS DATE) AS date, service_name, severity_text,
  mlflow_run_id, requester, body, CAST(json_extract_string(attributes, '$.k') AS BIGINT) AS k FROM otel_logs""",
)
def scan_otel_logs(spark, root):
    """Write the variant table as parquet and scan it back."""
    path = workspace.fresh_path(spark, "otel_logs")
    sinks.write_telemetry(B.otel_logs(spark, root), path)
    return spark.read.parquet(path).select(
        "record_id", "time", "date", "service_name", "severity_text",
        ops.attribute("resource.attributes", ops.RUN_KEY).alias("mlflow_run_id"),
        ops.attribute("resource.attributes", ops.REQUESTER_KEY).alias("requester"),
        F.try_variant_get("body", "$", "string").alias("body"),
        ops.attribute("attributes", "k", "bigint").alias("k"),
    )


@query(
    "variant_extract",
    """SELECT CAST(event_id AS VARCHAR) AS record_id, json_extract_string(attributes, '$.k') AS k, requester, body FROM otel_logs""",
)
def variant_extract(spark, root):
    return B.otel_logs(spark, root).select(
        "record_id",
        ops.attribute("attributes", "k").alias("k"),
        ops.attribute("resource.attributes", ops.REQUESTER_KEY).alias("requester"),
        F.try_variant_get("body", "$", "string").alias("body"),
    )


@query(
    "telemetry_identity_view",
    """SELECT time, service_name, requester AS requester_selfreported, mlflow_run_id, severity_text, body AS message FROM otel_logs ORDER BY time DESC""",
)
def telemetry_identity_view(spark, root):
    return usage_ops.newest_first(ops.identity_view(B.otel_logs(spark, root)), "time")


IDENTITY_VIEW = "SELECT time, service_name, requester AS requester_selfreported, mlflow_run_id, severity_text, body AS message FROM otel_logs"


def with_leaves(spark, root):
    """The log table as it is stored where its identity keys are asked for: a typed column for each."""
    path = workspace.fresh_path(spark, "otel_leaves")
    sinks.write_telemetry(B.otel_logs(spark, root), path, ops.IDENTITY_LEAVES)
    return spark.read.parquet(path)


@query("shredded_identity_view", IDENTITY_VIEW)
def shredded_identity_view(spark, root):
    """The self-reported view over stored leaves; the attributes themselves are not read."""
    return ops.identity_view(with_leaves(spark, root))


@query("shredded_identity_counts", "SELECT requester, mlflow_run_id, COUNT(*) AS log_rows FROM otel_logs WHERE requester < 'user5' GROUP BY 1, 2")
def shredded_identity_counts(spark, root):
    """Rows per run of some requesters; the filter reaches the leaf's row groups."""
    logs = with_leaves(spark, root)
    requester, run = (ops.attribute_of(logs, leaf.variant, leaf.key) for leaf in ops.IDENTITY_LEAVES)
    return logs.filter(requester < "user5").groupBy(requester.alias("requester"), run.alias("mlflow_run_id")).agg(F.count(F.lit(1)).alias("log_rows"))


@query("telemetry_summary", SUMMARY)
def telemetry_summary(spark, root):
    return ops.summary(B.otel_logs(spark, root))


@query(
    "telemetry_identity_join",
    f"""SELECT t.*, j.run_id AS job_run_id, j.run_as AS authoritative_identity, j.period_start_time, j.result_state
  FROM ({SUMMARY}) t JOIN timeline j ON list_contains([j.param_a, j.param_b], t.mlflow_run_id)""",
)
def telemetry_identity_join(spark, root):
    return ops.identity_join(ops.summary(B.otel_logs(spark, root)), B.timeline(spark, root))


STAMPED = """WITH told AS (SELECT user_id AS run_id, ts AS changed_at, CASE WHEN event_id % 250 <> 3 THEN 'user' || CAST(event_id AS VARCHAR) END AS requester, 'team-' || CAST(event_id % 7 AS VARCHAR) AS team
  FROM events WHERE event_id % 50 = 3)
SELECT event_id, user_id AS run_id, COALESCE(CASE WHEN event_id % 4 = 0 THEN 'self' END, requester) AS requester, team
  FROM events ASOF LEFT JOIN told ON user_id = told.run_id AND ts >= changed_at"""


def stamped_events(events):
    """Records of runs, every fourth with a requester of its own, and the identity changes among them."""
    key, run = F.col("event_id"), F.col("user_id").alias("run_id")
    records = events.select(key, F.col("ts").alias("time"), run, F.when(key % 4 == 0, "self").alias("requester"))
    told = events.filter(key % 50 == 3).select(
        run, F.col("ts").alias("changed_at"), F.when(key % 250 != 3, B.text("user", key)).alias("requester"), B.text("team-", key % 7).alias("team")
    )
    return records, told


@query("identity_as_of", STAMPED)
def identity_as_of(spark, root):
    """Every record with the identity its run had at the record's time."""
    return ops.stamp_as_of(*stamped_events(B.table(spark, root, "events"))).select("event_id", "run_id", "requester", "team")


@query(
    "requester_extract",
    """SELECT event_id, COALESCE(CASE WHEN event_id % 10 = 0 THEN 'override' || CAST(run AS VARCHAR) END,
  NULLIF(regexp_extract(line, '/Workspace/Users/([^/]+)/', 1), '')) AS requester FROM log_lines""",
)
def requester_extract(spark, root):
    override = F.when(F.col("event_id") % 10 == 0, B.text("override", F.col("run"))).otherwise("")
    return B.log_lines(spark, root).select("event_id", T.requester(override, F.col("line")).alias("requester"))


@query(
    "epoch_normalise",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) END AS started_utc FROM events""",
)
def epoch_normalise(spark, root):
    """Epoch milliseconds (null where a run has not started) to UTC timestamps."""
    millis = F.when(F.col("event_id") % 7 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return B.table(spark, root, "events").select(
        "event_id", F.timestamp_millis(millis).cast("timestamp_ntz").alias("started_utc")
    )


@query(
    "otel_sink",
    "SELECT CAST(time AS DATE) AS date, service_name, COUNT(*) AS rows FROM otel_logs GROUP BY 1, 2",
)
def otel_sink(spark, root):
    """Dated, clustered variant table; counted per date folder and service."""
    path = workspace.fresh_path(spark, "otel_sink")
    sinks.write_telemetry(B.otel_logs(spark, root), path)
    return spark.read.parquet(path).groupBy("date", "service_name").agg(F.count(F.lit(1)).alias("rows"))


GAUGED = """SELECT ts, 'svc-' || CAST(user_id % 20 AS VARCHAR) AS service_name, 'run-' || CAST(user_id % 20 AS VARCHAR) AS run, event_id % 8 AS gpu,
  CAST(FLOOR(value) AS BIGINT) % 101 AS util, event_id % 1000 AS used, 1000 AS total, value AS power, CAST(FLOOR(value) AS BIGINT) % 90 AS temp FROM events"""


@query(
    "scan_otel_metrics",
    """WITH m AS (SELECT *, unnest(range(7)) AS i FROM events)
SELECT CAST(event_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS record_id, ts AS time, CAST(ts AS DATE) AS date, 'svc-' || CAST(user_id % 20 AS VARCHAR) AS service_name,
  ['gpu.utilization.percent', 'gpu.memory.used.bytes', 'gpu.memory.total.bytes', 'gpu.power.watts', 'gpu.temperature.celsius', 'train.loss', 'train.steps'][i + 1] AS name,
  CASE i WHEN 0 THEN CAST(FLOOR(value) AS BIGINT) % 101 WHEN 1 THEN event_id % 1000 WHEN 2 THEN 1000 WHEN 3 THEN value WHEN 4 THEN CAST(FLOOR(value) AS BIGINT) % 90
    WHEN 5 THEN value / 50 ELSE event_id END::DOUBLE AS value, CASE WHEN i < 5 THEN CAST(event_id % 8 AS INT) END AS gpu FROM m""",
)
def scan_otel_metrics(spark, root):
    """Write the metric table as dated parquet and scan it back with the declared schema."""
    path = workspace.fresh_path(spark, "otel_metrics")
    sinks.write_telemetry(B.otel_metrics(spark, root), path)
    return spark.read.schema(schemas.TELEMETRY_METRICS).parquet(path).select(
        "record_id", "time", "date", "service_name", "name", "value", ops.attribute("attributes", ops.GPU_KEY, "int").alias("gpu")
    )


@query(
    "metric_utilization",
    f"""SELECT run AS team, date_trunc('day', ts) AS window_start, AVG(util) AS avg_util, CAST(quantile_disc(util, 0.95) AS DOUBLE) AS p95_util,
  CAST(MIN(total - used) AS DOUBLE) AS min_mem_headroom, COUNT(*) AS samples
  FROM (SELECT ts, service_name, run, gpu, MAX(util) AS util, MAX(used) AS used, MAX(total) AS total FROM ({GAUGED}) GROUP BY ALL) GROUP BY 1, 2""",
)
def metric_utilization(spark, root):
    """GPU gauges of the metric table as daily utilisation windows of each run."""
    return ops.window_utilization(ops.gpu_gauges(B.otel_metrics(spark, root)).withColumnRenamed("mlflow_run_id", "team"), "1 day")


@query(
    "training_progress",
    """SELECT 'run-' || CAST(user_id % 20 AS VARCHAR) AS mlflow_run_id, arg_max(value, ts) / 50 AS last_loss, CAST(MAX(event_id) AS DOUBLE) AS steps, MAX(ts) AS last_export
  FROM events GROUP BY 1""",
)
def training_progress(spark, root):
    return ops.training_progress(B.otel_metrics(spark, root))


@query(
    "failure_feed",
    """SELECT CAST(event_id AS VARCHAR) AS record_id, time, severity_text, requester FROM otel_logs WHERE severity_number >= 13
  ORDER BY time DESC, CAST(event_id AS VARCHAR) LIMIT 100""",
)
def failure_feed(spark, root):
    return ops.failure_feed(B.otel_logs(spark, root)).select(
        "record_id", "time", "severity_text", ops.attribute("resource.attributes", ops.REQUESTER_KEY).alias("requester")
    )


UTIL = """SELECT ts, 'team-' || CAST(node AS VARCHAR) AS team, node, CAST(temp_c AS DOUBLE) AS util_pct, 1000 AS mem_total, iters AS mem_used FROM gpu_samples"""


def utilization(spark, root, events=None):
    """GPU samples as utilisation rows; each node belongs to the team of its number."""
    return B.gpu_samples(spark, root, events).select(
        "ts", B.text("team-", F.col("node")).alias("team"), F.col("temp_c").cast("double").alias("util_pct"),
        F.lit(1000).alias("mem_total"), F.col("iters").alias("mem_used"),
    )


@query(
    "util_vs_quota",
    f"""SELECT u.team, window_start, avg_util, p95_util, min_mem_headroom, samples, quota_nodes FROM (
  SELECT team, date_trunc('day', ts) AS window_start, AVG(util_pct) AS avg_util, quantile_disc(util_pct, 0.95) AS p95_util,
    MIN(mem_total - mem_used) AS min_mem_headroom, COUNT(*) AS samples FROM ({UTIL}) GROUP BY 1, 2) u LEFT JOIN teams t ON t.team = u.team""",
)
def util_vs_quota(spark, root):
    return ops.utilization_by_team(utilization(spark, root), B.teams(spark, root), "1 day")


@query(
    "run_health_stale",
    """SELECT r.id, r.state, e.last_event, e.last_loss, e.last_util, date_sub('second', e.last_event, TIMESTAMP '2024-01-31 00:00:00') AS seconds_since,
  COALESCE(date_sub('second', e.last_event, TIMESTAMP '2024-01-31 00:00:00') > 600, TRUE) AS stale
  FROM runs r LEFT JOIN (SELECT user_id, MAX(ts) AS last_event, arg_max(value, ts) FILTER (WHERE event_type <> 'view') AS last_loss,
    arg_max(event_id % 100, ts) FILTER (WHERE event_type = 'view') AS last_util FROM events GROUP BY 1) e ON e.user_id = r.id % 200
  WHERE r.state IN ('QUEUED', 'SUBMITTED', 'RUNNING')""",
)
def run_health_stale(spark, root):
    active = B.runs(spark, root).filter(L.state_in(L.ACTIVE_STATES)).select("id", "state", (F.col("id") % 200).alias("run_id"))
    seen = B.table(spark, root, "events").select(
        F.col("user_id").alias("run_id"),
        "ts",
        F.when(F.col("event_type") != "view", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("event_id") % 100).alias("util"),
    )
    return ops.run_health(active, seen, B.ntz("2024-01-31 00:00:00"), ("loss", "util")).drop("run_id")


@query(
    "right_sizing",
    f"""SELECT b.team, dbus, avg_util, dbus * (100 - avg_util) / 100 AS idle_dbus FROM ({BY_TEAM}) b
  LEFT JOIN (SELECT team, AVG(util_pct) AS avg_util FROM ({UTIL}) GROUP BY 1) u ON u.team = b.team""",
)
def right_sizing(spark, root):
    return ops.right_sizing(utilization(spark, root), by_team(spark, root))


@query(
    "audit_events",
    """SELECT created_at AS time, 'pool-hub' AS service_name, 'run_requested' AS event_name, requested_by AS requester, team, shape, nodes,
  'run ' || CAST(id AS VARCHAR) || ' of ' || name AS message FROM ledger""",
)
def audit_events(spark, root):
    return ops.audit_events(B.ledger(spark, root))
