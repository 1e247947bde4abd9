"""Telemetry logs and the two kinds of identity (family C).

Self-reported identity (an attribute the workload sets) and authoritative identity (the job
timeline) stay in separate columns throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsight.operators import ordering
from poolsight.sources.leaves import Leaf, attribute, attribute_of

REQUESTER_KEY = "workload.requester"
RUN_KEY = "workload.run_id"
WARN_SEVERITY = 13  # fixed value: WARN in the telemetry severity scale


#: The keys by which telemetry is read; see `sources.leaves`.
IDENTITY_LEAVES = (Leaf("resource.attributes", REQUESTER_KEY), Leaf("resource.attributes", RUN_KEY))


def identity_view(logs: DataFrame, requester_key: str = REQUESTER_KEY, run_key: str = RUN_KEY) -> DataFrame:
    """Self-reported view of the log table."""
    return logs.select(
        "time",
        "service_name",
        attribute_of(logs, "resource.attributes", requester_key).alias("requester_selfreported"),
        attribute_of(logs, "resource.attributes", run_key).alias("mlflow_run_id"),
        "severity_text",
        F.try_variant_get("body", "$", "string").alias("message"),
    )


def summary(logs: DataFrame, run_key: str = RUN_KEY) -> DataFrame:
    """Rows and time span per run id; aggregated before any join."""
    return logs.groupBy(attribute_of(logs, "resource.attributes", run_key).alias("mlflow_run_id")).agg(
        F.count(F.lit(1)).alias("log_rows"),
        F.min("time").alias("first_event"),
        F.max("time").alias("last_event"),
    )


def identity_join(summaries: DataFrame, timeline: DataFrame) -> DataFrame:
    """Telemetry runs to job runs whose parameters hold the run id as a value.

    `array_contains(map_values(..), id)` would plan a nested loop. Each job run's distinct
    parameter values are exploded instead, so this is an equi join; `array_distinct` keeps a
    value that occurs under two keys from matching twice.
    """
    keyed = timeline.select(
        F.col("run_id").alias("job_run_id"),
        F.col("identity_metadata.run_as").alias("authoritative_identity"),
        "period_start_time",
        "result_state",
        F.explode(F.array_distinct(F.map_values("job_parameters"))).alias("_value"),
    ).filter(F.col("_value").isNotNull())
    return summaries.join(keyed, F.col("mlflow_run_id") == F.col("_value")).drop("_value")


def stamp_identity(records: DataFrame, identity: DataFrame, on: str = "run_id") -> DataFrame:
    """Put the client's baggage (requester, team) on every record that lacks its own value.

    `identity` has one row per run; it may be static beside a stream of records.
    """
    baggage = identity.select(
        F.col(on).alias("_run"), F.col("requester").alias("_requester"), F.col("team").alias("_team")
    )
    stamped = records.join(baggage, F.col(on) == F.col("_run"), "left")
    for name in ("requester", "team"):
        own = F.col(name) if name in records.columns else F.lit(None).cast("string")
        stamped = stamped.withColumn(name, F.coalesce(own, F.col(f"_{name}")))
    return stamped.drop("_run", "_requester", "_team")


def stamp_as_of(records: DataFrame, changes: DataFrame, on: str = "run_id", at: str = "time") -> DataFrame:
    """Put on every record that lacks its own value the requester and team in force at its time.

    `changes` has a row (run_id, changed_at, requester, team) whenever a run's identity changes; one counts from
    its own instant on, until the run's next. Of changes at one instant that with the greatest (requester, team)
    counts, nulls least; a change to null withdraws the value. A record before its run's first change, and
    one without a run or a time, keeps what it has; a change without them is none.

    Instants and changes are put in order together, range by range, and the change in force is the latest so far,
    which earlier ranges hand on: a run with most of the records or changes spreads over ranges, and the work
    grows with records and changes, not with their product.
    """
    instants = records.select(F.col(on).alias("_run"), F.col(at).alias("_at")).dropna().distinct()
    moment = F.col("changed_at").cast(records.schema[at].dataType)
    told = changes.select(F.col(on).alias("_r"), moment.alias("_told"), F.col("requester").alias("_requester"), F.col("team").alias("_team"))
    greatest = Window.partitionBy("_r", "_told").orderBy(F.col("_requester").desc_nulls_last(), F.col("_team").desc_nulls_last())
    told = told.dropna(subset=["_r", "_told"]).withColumn("_nth", F.row_number().over(greatest)).filter("_nth = 1").drop("_nth")
    concerned = told.join(instants.select(F.col("_run").alias("_r")).distinct(), "_r", "left_semi")
    lines = concerned.select(F.col("_r").alias("_run"), F.col("_told").alias("_at"), "_told")
    rows = ordering.ranged(instants.unionByName(lines, allowMissingColumns=True), ["_run"], ["_at"])
    latest = rows.groupBy("_run", "_range").agg(F.max("_told").alias("_latest"))
    earlier = Window.partitionBy("_run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_run", "_range", F.max("_latest").over(earlier).alias("_carry"))
    # a change counts at its own instant
    here = Window.partitionBy("_run", "_range").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("*", F.max("_told").over(here).alias("_newest")).filter(F.col("_told").isNull())
    in_force = placed.join(carried, ["_run", "_range"]).select("_run", "_at", F.coalesce("_newest", "_carry").alias("_since"))
    in_force = in_force.join(told, (F.col("_run") == F.col("_r")) & (F.col("_since") == F.col("_told")))
    stamped = records.join(in_force, (F.col(on) == F.col("_run")) & (F.col(at) == F.col("_at")), "left")
    for name in ("requester", "team"):
        own = F.col(name) if name in records.columns else F.lit(None).cast("string")
        stamped = stamped.withColumn(name, F.coalesce(own, F.col(f"_{name}")))
    return stamped.drop("_run", "_at", "_since", "_r", "_told", "_requester", "_team")


# Names of the exported gauges and counter, and the attribute of a GPU's number.
GPU_KEY = "gpu"
UTIL, MEM_USED, MEM_TOTAL = "gpu.utilization.percent", "gpu.memory.used.bytes", "gpu.memory.total.bytes"
POWER, TEMPERATURE = "gpu.power.watts", "gpu.temperature.celsius"
LOSS, STEPS = "train.loss", "train.steps"


def gpu_gauges(metrics: DataFrame, *kept: str) -> DataFrame:
    """One row per sample of a GPU: its five gauges side by side, with run, GPU number and `kept` columns.

    Readings of one export share time, service and GPU; a gauge missing from an export stays null, of a
    repeated reading the largest counts.
    """
    run = attribute_of(metrics, "resource.attributes", RUN_KEY)
    gpu = attribute_of(metrics, "attributes", GPU_KEY, "int")
    named = {"util_pct": UTIL, "mem_used": MEM_USED, "mem_total": MEM_TOTAL, "power_w": POWER, "temp_c": TEMPERATURE}
    readings = metrics.filter(F.col("name").isin(*named.values()))
    return readings.groupBy(F.col("time").alias("ts"), "service_name", run.alias("mlflow_run_id"), gpu.alias("gpu"), *kept).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(column) for column, name in named.items()]
    )


def training_progress(metrics: DataFrame) -> DataFrame:
    """Latest loss and number of steps per run; the counter never falls, so its largest value is the latest."""
    run = attribute_of(metrics, "resource.attributes", RUN_KEY)
    at_loss = F.when((F.col("name") == LOSS) & F.col("value").isNotNull(), F.col("time"))
    return (
        metrics.filter(F.col("name").isin(LOSS, STEPS))
        .groupBy(run.alias("mlflow_run_id"))
        .agg(
            F.max_by("value", at_loss).alias("last_loss"),
            F.max(F.when(F.col("name") == STEPS, F.col("value"))).alias("steps"),
            F.max("time").alias("last_export"),
        )
    )


def failure_feed(logs: DataFrame, limit: int = 100, min_severity: int = WARN_SEVERITY) -> DataFrame:
    """Latest rows at WARN or above; a top-k plan, so tasks keep `limit` rows each."""
    return (
        logs.filter(F.col("severity_number").cast("int") >= min_severity)
        .orderBy(F.col("time").desc(), "record_id")
        .limit(limit)
    )


def utilization_counts(samples: DataFrame, window: str = "1 hour") -> DataFrame:
    """Samples per team, tumbling window and value, with the least memory headroom: rows that merge."""
    return (
        samples.groupBy(F.window("ts", window).alias("w"), "team", "util_pct")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("mem_total") - F.col("mem_used")).alias("headroom"))
        .select("team", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "util_pct", "n", "headroom")
    )


def merge_utilization_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("team", "window_start", "util_pct").agg(
        F.sum("n").alias("n"), F.min("headroom").alias("headroom")
    )


def utilization_from_counts(counts: DataFrame, percent: int = 95) -> DataFrame:
    """Average and exact percentile of utilisation and least memory headroom per team and window.

    The percentile is the least value that `percent` of the samples do not exceed, found on counts by
    value; running counts are taken range by range, so a window with most samples still spreads.
    """
    group = ["team", "window_start"]
    valued = counts.withColumn("known", F.when(F.col("util_pct").isNotNull(), F.col("n")).otherwise(0))
    ranked = ordering.running_totals(valued, ["util_pct"], {"upto": "known"}, group)
    totals = valued.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.sum("known").alias("total"))
    reached = 100 * F.col("upto") >= percent * F.col("total")
    return (
        ranked.join(totals, ordering.same(group, "_of_"))
        .groupBy(*group)
        .agg(
            (F.sum(F.col("util_pct") * F.col("known")) / F.nullif(F.sum("known"), F.lit(0))).alias("avg_util"),
            F.min(F.when(reached, F.col("util_pct"))).alias("p95_util"),
            F.min("headroom").alias("min_mem_headroom"),
            F.sum("n").alias("samples"),
        )
    )


def window_utilization(samples: DataFrame, window: str = "1 hour") -> DataFrame:
    """Utilisation per team and tumbling window of a batch of samples."""
    return utilization_from_counts(utilization_counts(samples, window))


def beat_sessions(heartbeats: DataFrame, silent_for: str = "10 minutes") -> DataFrame:
    """Runs of heartbeats less than `silent_for` apart, per run: rows that merge. A beat without a time is none.

    Beats of one tumbling window of that width are always one session, so they are counted before any
    shuffle; a run with most of the beats then is a row a window, and not its beats, in the task that joins them.
    """
    spans = (
        heartbeats.select("run_id", F.col("ts").cast("timestamp").alias("ts"))
        .groupBy("run_id", F.window("ts", silent_for).alias("w"))
        .agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"))
        .select("run_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_event", "last_event")], "events")
    )
    return merge_sessions(spans, silent_for)


def merge_sessions(sessions: DataFrame, silent_for: str = "10 minutes") -> DataFrame:
    """Sessions of any parts of the heartbeats give the sessions of all of them."""
    by_start = Window.partitionBy("run_id").orderBy("first_event", "last_event")
    reached = F.max("last_event").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = reached.isNull() | (F.col("first_event") >= reached + F.expr(f"INTERVAL {silent_for}"))
    numbered = sessions.withColumn("_opens", opens.cast("int")).withColumn("_n", F.sum("_opens").over(by_start))
    return (
        numbered.groupBy("run_id", "_n")
        .agg(F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), F.sum("events").alias("events"))
        .drop("_n")
    )


def silent_runs(sessions: DataFrame, active: DataFrame, silent_for: str = "10 minutes") -> DataFrame:
    """Sessions of active runs, and whether the run has fallen silent after each."""
    now = sessions.agg(F.max("last_event")).scalar()
    silent = F.col("last_event") + F.expr(f"INTERVAL {silent_for}") <= now
    return sessions.join(active, "run_id").select(
        "run_id", "last_event", "events", *[c for c in active.columns if c != "run_id"], silent.alias("silent")
    )


def utilization_by_team(samples: DataFrame, teams: DataFrame, window: str = "1 hour") -> DataFrame:
    """Windowed utilisation beside the declared quota of each team."""
    return window_utilization(samples, window).join(teams.select("team", "quota_nodes"), "team", "left")


def run_health(
    active: DataFrame,
    telemetry: DataFrame,
    as_of: Column,
    measures: Sequence[str] = ("loss",),
    stale_after_s: int = 600,
) -> DataFrame:
    """Active runs with their latest event and measures; no event or an old one marks a hung run.

    A measure may be null on most rows; its last known value counts.
    """

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ts"))).alias(f"last_{name}")

    latest = telemetry.groupBy("run_id").agg(F.max("ts").alias("last_event"), *[last(m) for m in measures])
    seconds = F.timestamp_diff("SECOND", F.col("last_event"), as_of)
    return active.join(latest, "run_id", "left").select(
        *active.columns,
        "last_event",
        *[f"last_{m}" for m in measures],
        seconds.alias("seconds_since"),
        F.coalesce(seconds > stale_after_s, F.lit(True)).alias("stale"),
    )


def right_sizing(utilization: DataFrame, billed: DataFrame) -> DataFrame:
    """Billed units of each team weighed by its mean utilisation."""
    mean = utilization.groupBy("team").agg(F.avg("util_pct").alias("avg_util"))
    return billed.select("team", "dbus").join(mean, "team", "left").select(
        "team",
        "dbus",
        "avg_util",
        (F.col("dbus") * (F.lit(100) - F.col("avg_util")) / 100).alias("idle_dbus"),
    )


def landed_counts(landed: DataFrame, within_s: int = 30) -> DataFrame:
    """Rows of (source, sent_at, landed_at) counted per source, in all and in time."""
    on_time = F.col("landed_at") <= F.col("sent_at") + F.make_dt_interval(secs=F.lit(within_s).cast("decimal(18,6)"))
    return landed.groupBy("source").agg(F.count(F.lit(1)).alias("landed"), F.count_if(on_time).alias("on_time"))


def merge_landed_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source").agg(F.sum("landed").alias("landed"), F.sum("on_time").alias("on_time"))


def delivery_alerts(counts: DataFrame, sent: DataFrame) -> DataFrame:
    """Acks prove nothing: sources whose rows landed in time fall short of their sent counter.

    `counts` may hold several partial counts per source, one per micro-batch.
    """
    arrived = merge_landed_counts(counts)
    landed, on_time = F.coalesce("landed", F.lit(0)), F.coalesce("on_time", F.lit(0))
    return sent.join(arrived, "source", "left").select(
        "source",
        "expected",
        landed.cast("bigint").alias("landed"),
        on_time.cast("bigint").alias("on_time"),
        (on_time < F.col("expected")).alias("alert"),
    )


def audit_events(requests: DataFrame, service: str = "pool-hub") -> DataFrame:
    """The hub's own submissions as telemetry rows."""
    return requests.select(
        F.col("created_at").alias("time"),
        F.lit(service).alias("service_name"),
        F.lit("run_requested").alias("event_name"),
        F.col("requested_by").alias("requester"),
        "team",
        "shape",
        "nodes",
        F.concat(F.lit("run "), F.col("id").cast("string"), F.lit(" of "), F.col("name")).alias("message"),
    )
