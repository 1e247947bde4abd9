"""Identity, delivery and health panels on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from poolsight.operators import telemetry as ops
from poolsight.sources import schemas

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_identity_join_matches_a_value_once(spark):
    summaries = spark.createDataFrame([("7", 3), ("8", 1), (None, 2)], "mlflow_run_id string, log_rows bigint")
    timeline = spark.createDataFrame(
        [(1, {"a": "7", "b": "7"}, ("ann",), T0, "SUCCESS"), (2, {"a": "x", "b": None}, ("bob",), T0, "FAILED"), (3, None, ("eve",), T0, "FAILED")],
        schemas.JOB_RUN_TIMELINE,
    )
    got = [(r.mlflow_run_id, r.job_run_id, r.authoritative_identity) for r in ops.identity_join(summaries, timeline).collect()]
    assert got == [("7", 1, "ann")]


def test_dotted_attribute_is_one_key(spark):
    df = spark.range(1).select(F.parse_json(F.lit('{"workload.requester": "me", "workload": {"requester": "no"}}')).alias("v"))
    assert df.select(ops.attribute("v", "workload.requester").alias("x")).first().x == "me"


def test_stamp_keeps_own_identity(spark):
    records = spark.createDataFrame([(1, "own"), (1, None), (2, None)], "run_id int, requester string")
    identity = spark.createDataFrame([(1, "client", "team")], "run_id int, requester string, team string")
    got = {(r.run_id, r.requester, r.team) for r in ops.stamp_identity(records, identity).collect()}
    assert got == {(1, "own", "team"), (1, "client", "team"), (2, None, None)}


def test_delivery_alerts_on_missing_late_and_absent(spark):
    landed = spark.createDataFrame(
        [("a", T0, at(0)), ("b", T0, at(0)), ("b", T0, at(1)), ("c", T0, T0 + dt.timedelta(seconds=30))], "source string, sent_at timestamp_ntz, landed_at timestamp_ntz"
    )
    sent = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 1)], "source string, expected bigint")
    got = {r.source: (r.landed, r.on_time, r.alert) for r in ops.delivery_alerts(ops.landed_counts(landed), sent).collect()}
    assert got == {"a": (1, 1, True), "b": (2, 1, True), "c": (1, 1, False), "d": (0, 0, True)}


def test_run_health_keeps_last_known_measures(spark):
    active = spark.createDataFrame([(1,), (2,), (3,)], "run_id int")
    events = spark.createDataFrame(
        [(1, at(0), 2.5, None), (1, at(58), None, 40), (2, at(1), 1.0, 10)], "run_id int, ts timestamp_ntz, loss double, util int"
    )
    board = ops.run_health(active, events, F.lit(at(60)), ("loss", "util"))
    got = {r.run_id: (r.last_loss, r.last_util, r.seconds_since, r.stale) for r in board.collect()}
    assert got == {1: (2.5, 40, 120, False), 2: (1.0, 10, 3540, True), 3: (None, None, None, True)}


def test_failure_feed_is_newest_first_and_filters(spark):
    logs = spark.createDataFrame([("a", at(1), "9"), ("b", at(2), "13"), ("c", at(3), "17"), ("d", at(4), "21")], "record_id string, time timestamp_ntz, severity_number string")
    assert [r.record_id for r in ops.failure_feed(logs, 2).collect()] == ["d", "c"]


def test_utilization_and_right_sizing(spark):
    samples = spark.createDataFrame(
        [("a", at(1), 10.0, 80, 20), ("a", at(2), 30.0, 80, 70), ("b", at(61), 50.0, 80, 10)], "team string, ts timestamp_ntz, util_pct double, mem_total int, mem_used int"
    )
    teams = spark.createDataFrame([("a", 4)], "team string, quota_nodes int")
    got = {r.team: (r.avg_util, r.p95_util, r.min_mem_headroom, r.quota_nodes) for r in ops.utilization_by_team(samples, teams).collect()}
    assert got == {"a": (20.0, 30.0, 10, 4), "b": (50.0, 50.0, 70, None)}
    billed = spark.createDataFrame([("a", 100.0), ("c", 5.0)], "team string, dbus double")
    sized = {r.team: r.idle_dbus for r in ops.right_sizing(samples, billed).collect()}
    assert sized == {"a": 80.0, "c": None}
