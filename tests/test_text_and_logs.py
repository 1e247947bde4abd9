"""Log mining on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from poolsight.functions import text as T
from poolsight.operators import logs as ops


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [
    ("\x1b[32mJob Run ID: 968264353316767\x1b[0m", "968264353316767"), ('{"run_id": 12345678}', "12345678"), ("run_id=1234", None), ("nothing", None),
])
def test_job_run_id(spark, text, want):
    assert one(spark, text, T.job_run_id) == want


@pytest.mark.parametrize("text,want", [
    ("8", 8.0), ("4K", 4096.0), ("2m", 2097152.0), ("1G", 1073741824.0), ("1.5K", 1536.0), ("1 GB", 1073741824.0), ("3T", -1.0), ("abc", -1.0), ("", -1.0),
    ("1e3", 1000.0), (".5K", 512.0), ("-2M", -2097152.0), ("+1.k", 1024.0), ("1e2 G", 107374182400.0), (".", -1.0),
])
def test_size_bytes(spark, text, want):
    assert one(spark, text, T.size_bytes) == want


@pytest.mark.parametrize("text,want", [("1.5", 1.5), ("-2e3", -2000.0), (".5", 0.5), ("1d", None), ("", None), ("n/a", None), ("nan", None)])
def test_number_or_null(spark, text, want):
    assert one(spark, text, T.number_or_null) == want


def test_requester_override_wins(spark):
    df = spark.createDataFrame([("me", "/Workspace/Users/a@b/x"), ("", "/Workspace/Users/a@b/x"), (None, "elsewhere")], "o string, p string")
    assert [r.r for r in df.select(T.requester(F.col("o"), F.col("p")).alias("r")).collect()] == ["me", "a@b", None]


def test_result_pairs_keep_quoted_values(spark):
    df = spark.createDataFrame([(1, "RESULT gpu=0 name='GPU X 80GB' tflops=701.5"), (2, "a RESULT x=1"), (3, "RESULT holding")], "run int, line string")
    got = {(r.run, r.key): r.value for r in ops.result_line_kv(df).collect()}
    assert got == {(1, "gpu"): "0", (1, "name"): "GPU X 80GB", (1, "tflops"): "701.5"}


@pytest.mark.parametrize("text,want", [
    ("Killed, exit 137", "host_ram_oom"), ("Traceback ... exit 137", None), ("CUDA out of memory", "gpu_oom"), ("fine", None),
])
def test_failure_symptom(spark, text, want):
    assert one(spark, text, T.failure_symptom) == want


def launcher(spark):
    lines = [
        "2026-07-17 21:46:36 - INFO - Recorded condition marker /work/LauncherStarted",
        "2026-07-17 21:46:36 - INFO - DEBUG_INFO:",
        "2026-07-17 21:46:36 - INFO -   job_id=712006875698868",
        "2026-07-17 21:46:36 - INFO -   workload_id=68852892-281b",
        "2026-07-17 21:46:40 - INFO - Recorded condition marker /work/UserCodeStarted",
        "2026-07-17 21:49:50 - INFO - User command exited with code 3",
        "stray text",
        "2026-13-45 99:99:99 - INFO - impossible date",
    ]
    return ops.launcher_parse(spark.createDataFrame([("f", x) for x in lines], "file string, line string"))


def test_launcher_block(spark):
    parsed = launcher(spark)
    assert parsed.filter("message IS NULL").count() == 1
    ids = ops.correlation_ids(parsed).first()
    assert (ids.job_id, ids.workload_id, ids.run_id) == ("712006875698868", "68852892-281b", None)
    phase = ops.phase_duration(parsed).first()
    assert (phase.exit_code, phase.seconds, phase.user_code_at) == (3, 194, dt.datetime(2026, 7, 17, 21, 46, 40))


def test_json_results_three_valued_and_broken(spark):
    rows = [("a", '{"check": "c", "results": {"p": {"ok": null, "detail": "d"}, "q": {"ok": true, "detail": "e"}}}'), ("b", "not json"), ("c", None)]
    got = {(r.k, r.probe): r.ok for r in ops.json_results(spark.createDataFrame(rows, "k string, payload string")).collect()}
    assert got == {("a", "p"): None, ("a", "q"): True, ("b", "_output"): False, ("c", "_output"): False}


def test_melt_skips_text_null_and_nan(spark):
    df = spark.createDataFrame([("d", 1.0, float("nan"), None, "x", 3)], "dataset string, a double, b double, c double, t string, n int")
    got = {r.key: r.value for r in ops.melt_metrics(df, "dataset", ["a", "b", "c", "t", "n"]).collect()}
    assert got == {"d.a": 1.0, "d.n": 3.0}


def test_sanitise(spark):
    params = spark.createDataFrame([(1, "a:b", "v" * 600, 1), (1, "a=b", "last", 2)], "run int, key string, value string, seq int")
    assert [tuple(r) for r in ops.sanitise_params(params).collect()] == [(1, "a_b", "last")]
    metrics = spark.createDataFrame([(1, "x@y", "int", "3", 0), (1, "f", "bool", "1", 0)], "run int, key string, kind string, value string, step int")
    assert [(r.key, r.value) for r in ops.sanitise_metrics(metrics).collect()] == [("x_y", 3.0)]


def test_receipt_lookup_first_missing_and_required(spark):
    receipts = spark.createDataFrame(
        [(1, dt.datetime(2026, 1, 2), 11, "b"), (1, dt.datetime(2026, 1, 1), 12, "a")], "job_run_id int, logged_at timestamp_ntz, receipt_id bigint, params string"
    )
    runs = spark.createDataFrame([(1,), (2,)], "job_run_id int")
    assert {r.job_run_id: r.receipt_id for r in ops.receipt_lookup(runs, receipts).collect()} == {1: 12, 2: None}
    with pytest.raises(Exception, match="no receipt"):
        ops.receipt_lookup(runs, receipts, required=True).collect()


def test_latest_metric_breaks_step_ties_by_time(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame(
        [(1, "k", 1.0, 5, t), (1, "k", 2.0, 5, t + dt.timedelta(seconds=1)), (1, "k", 9.0, 4, t + dt.timedelta(days=1))],
        "run int, key string, value double, step bigint, ts timestamp_ntz",
    )
    got = ops.metric_history_latest(df).first()
    assert (got.points, got.last_step, got.latest) == (3, 5, 2.0)


def test_archive_overrides_provenance_and_records_missing_artifacts(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    params = spark.createDataFrame([(1, "p", "v")], "run int, key string, value string")
    metrics = spark.createDataFrame([(1, "m", 1.5, 0, dt.datetime(2026, 1, 1))], "run int, key string, value double, step bigint, ts timestamp_ntz")
    tags = spark.createDataFrame([(1, "archive.source_profile", "old"), (1, "t", "v")], "run int, key string, value string")
    artifacts = spark.createDataFrame([(1, "a.txt")], "run int, path string")
    out = ops.archive_runs(params, metrics, tags, artifacts, runs, {"source_profile": "new"})
    got = {(r.run, r.kind, r.key): r.value for r in out.collect()}
    assert got[(1, "tag", "archive.source_profile")] == "new" and got[(1, "metric", "m")] == "1.5"
    assert got[(2, "tag", "archive.artifacts_error")] == "no artifacts" and (1, "tag", "archive.artifacts_error") not in got
    assert out.count() == 1 + 1 + 1 + 4 + 1 + 1


def test_sentinel_presence(spark):
    df = spark.createDataFrame([(1, "X OK"), (1, "X OK again"), (2, "none")], "run int, line string")
    assert [tuple(r) for r in ops.sentinel_presence(df, ["X OK", "Y"]).collect()] == [(1, "X OK", 2)]
