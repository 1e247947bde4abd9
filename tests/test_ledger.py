"""Ledger semantics on small fixtures, and the skew-proof counters against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsight.functions import ledger as L
from poolsight.operators import colocation, ordering
from poolsight.operators import ledger as ops

RES = ops.Reservation(total_nodes=20)
START = dt.datetime(2026, 1, 1)

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, state string, team string, shape string, nodes int")


def teams(spark, *rows):
    return spark.createDataFrame(list(rows), "team string, pos int, quota_nodes int")


def test_admittable_takes_smallest_positive_cap(spark):
    df = spark.createDataFrame([(4, 20, 1), (0, 20, 3), (0, 0, 5), (4, 20, 9), (0, 0, 1200)], "q bigint, r bigint, f bigint")
    got = df.select(L.admittable([F.col("q"), F.col("r")], F.col("f")).alias("a")).collect()
    assert [r.a for r in got] == [3, 17, 994, 0, 0]


def test_shape_capacity_counts_only_holding_runs(spark):
    df = ledger(spark, (1, "RUNNING", "t", "GPU_8xH100", 2), (2, "SUBMITTED", "t", "GPU_8xH100", 1), (3, "QUEUED", "t", "GPU_8xH100", 9))
    shapes = ops.shape_set(df.select("shape"), RES)
    got = {r["shape"]: (r.in_flight, r.admittable) for r in ops.shape_capacity(shapes, df, RES, {"GPU_8xH100": 4}).collect()}
    assert got == {"GPU_8xH100": (3, 1), "GPU_1xA10": (0, 999), "GPU_1xH100": (0, 999)}


def test_fair_share_order_and_zero_quota_last(spark):
    df = ledger(
        spark, (1, "RUNNING", "a", "S", 4), (2, "RUNNING", "b", "T", 1),
        (10, "QUEUED", "none", "S", 1), (11, "QUEUED", "zero", "S", 1), (12, "QUEUED", "a", "S", 1), (13, "QUEUED", "b", "S", 1), (14, "QUEUED", "b", "S", 1),
    )
    ranked = ops.fair_share_rank(df, teams(spark, ("a", 0, 8), ("b", 1, 4), ("zero", 2, 0)))
    assert [r.id for r in ranked.orderBy("queue_position").collect()] == [13, 14, 12, 10, 11]


def test_fits_now_needs_capacity_and_team_room(spark):
    df = ledger(
        spark, (1, "RUNNING", "a", "GPU_8xH100", 3), (10, "QUEUED", "a", "GPU_8xH100", 2), (11, "QUEUED", "a", "GPU_8xH100", 1),
        (12, "QUEUED", "x", "GPU_1xA10", 1), (13, "QUEUED", "b", "GPU_1xA10", 3),
    )
    fits = ops.fits_now(df, teams(spark, ("a", 0, 8), ("b", 1, 2)), RES, {"GPU_8xH100": 4})
    assert {r.id: r.fits for r in fits.collect()} == {10: False, 11: True, 12: False, 13: False}


def test_headroom_of_unknown_team_is_zero(spark):
    df = ledger(spark, (1, "RUNNING", "a", "S", 9))
    asked = spark.createDataFrame([("a",), ("b",), ("x",)], "team string")
    got = {r.team: r.headroom for r in ops.team_headroom(asked, teams(spark, ("a", 0, 8), ("b", 1, 3)), df).collect()}
    assert got == {"a": 0, "b": 3, "x": 0}


def test_membership_gate_reasons(spark):
    members = spark.createDataFrame([("a", "Ann"), ("a", "ANN"), ("b", "bob")], "team string, member string")
    cases = spark.createDataFrame([("a", "u")], "team string, use_case string")
    requests = spark.createDataFrame(
        [("ann", "a", "u"), ("ann", "a", "v"), ("ann", "b", "u"), ("eve", "a", "u"), ("ann", None, None)],
        "principal string, team string, use_case string",
    )
    got = [r.reason for r in ops.membership_gate(requests, members, cases).collect()]
    assert Counter(got) == Counter(["ok", "not_a_use_case", "not_a_member", "read_only", "workload_not_found"])


def test_upsert_keeps_created_and_never_deletes(spark):
    schema = "id int, name string, created_by string, created_at string, team string"
    target = spark.createDataFrame([(1, "x", "repo", "old", "a"), (2, "y", "hand", "old", "b"), (3, "z", "repo", "old", "c")], schema)
    source = spark.createDataFrame([(9, "x", "repo", "new", None), (8, "y", "repo", "new", "n")], schema)
    everyone = {tuple(r) for r in ops.upsert_by_name(target, source).collect()}
    assert everyone == {(1, "x", "repo", "old", None), (2, "y", "hand", "old", "n"), (3, "z", "repo", "old", "c")}
    owned = {tuple(r) for r in ops.upsert_by_name(target, source, owner="repo").collect()}
    assert owned == {(1, "x", "repo", "old", None), (2, "y", "hand", "old", "b"), (3, "z", "repo", "old", "c"), (8, "y", "repo", "new", "n")}


def test_poll_fold_terminal_absorbs(spark):
    polls = spark.createDataFrame(
        [(1, START, 1, "PENDING", None), (2, START, 1, "RUNNING", None), (5, START, 1, "TERMINATED", "CANCELED"), (6, START, 1, "RUNNING", None),
         (7, START, 1, "TERMINATED", "SUCCESS"), (1, START, 2, "PENDING", None), (3, START, 3, "RUNNING", None), (4, START, 4, "SKIPPED", None),
         (4, START, 5, "TERMINATED", "TIMEDOUT")],
        "seq bigint, ts timestamp_ntz, run_id int, life string, result string",
    )
    got = {r.run_id: r.state for r in ops.fold_polls(polls).collect()}
    assert got == {1: "CANCELED", 2: "SUBMITTED", 3: "RUNNING", 4: "FAILED", 5: "FAILED"}


def test_catalog_shadow_prefers_live(spark):
    paths = ["a/x.example.yaml", "a/x.yaml", "b/x.example.yaml", "c/x.yaml"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in ops.catalog_shadow(df).collect()} == {"a/x.yaml", "b/x.example.yaml", "c/x.yaml"}


def test_use_case_is_hint_major(spark):
    df = spark.createDataFrame([(["xgboost-probes", "tabicl"],), (["plain", "x/tabicl/y", "probes"],), (["none"],), ([],)], "h array<string>")
    got = [r.u for r in df.select(L.use_case(F.col("h")).alias("u")).collect()]
    assert got == ["env-diagnostics", "classic-ml", "env-diagnostics", "env-diagnostics"]


def test_node_count(spark):
    df = spark.createDataFrame([(16, "GPU_8xH100"), (7, "GPU_8xH100"), (3, "GPU_1xA10"), (None, "GPU_1xA10")], "n int, s string")
    assert [r.n for r in df.select(L.node_count(F.col("n"), F.col("s")).alias("n")).collect()] == [2, 1, 3, 1]


holds = st.lists(
    st.tuples(st.sampled_from(["n1", "n2"]), st.integers(0, 400), st.integers(0, 200), st.sets(st.integers(0, 2), min_size=1)),
    min_size=1, max_size=40,
)


def as_probes(spark, drawn):
    rows = [
        (i, boot, START + dt.timedelta(minutes=s), START + dt.timedelta(minutes=s + n), [f"g{u}" for u in sorted(units)])
        for i, (boot, s, n, units) in enumerate(drawn)
    ]
    return rows, spark.createDataFrame(rows, "probe_id int, boot_id string, hold_start timestamp_ntz, hold_end timestamp_ntz, gpu_uuids array<string>")


@few
@given(drawn=holds)
def test_colocation_equals_pairs(spark, drawn):
    rows, df = as_probes(spark, drawn)
    real = [r for r in rows if r[3] > r[2]]
    want = {}
    for a in real:
        others = [b for b in real if b[0] != a[0] and b[1] == a[1] and a[2] < b[3] and b[2] < a[3]]
        shared = sum(bool(set(a[4]) & set(b[4])) for b in others)
        want[a[0]] = (len(others), shared)
    assert {r.probe_id: (r.cotenants, r.gpu_cotenants) for r in colocation.colocation(df).collect()} == want


@few
@given(drawn=holds)
def test_peak_equals_sweep(spark, drawn):
    rows, df = as_probes(spark, drawn)
    moments = {r[2] for r in rows}
    want = max(sum(r[2] <= m < r[3] for r in rows) for m in moments)
    (got,) = ops.peak_concurrency(df, "hold_start", "hold_end", known_cap=2).collect()
    assert (got.peak, got.cap) == (want, max(want, 2))


@few
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9)), min_size=1, max_size=60))
def test_running_totals_equal_plain_sums(spark, values):
    rows = [(g, i, v) for i, (g, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, i bigint, v bigint")
    got = ordering.running_totals(df, ["i"], {"total": "v"}, ["g"])
    sums, want = Counter(), {}
    for g, i, v in rows:
        sums[g] += v
        want[i] = sums[g]
    assert {r.i: r.total for r in got.collect()} == want


def test_a_probe_beside_holds_on_each_of_its_gpus(spark):
    rows = [(0, "n", START, START + dt.timedelta(hours=1), ["g0", "g1"]), (1, "n", START, START + dt.timedelta(hours=1), ["g0"]), (2, "n", START, START + dt.timedelta(hours=1), ["g1"])]
    df = spark.createDataFrame(rows, "probe_id int, boot_id string, hold_start timestamp_ntz, hold_end timestamp_ntz, gpu_uuids array<string>")
    assert {r.probe_id: (r.cotenants, r.gpu_cotenants) for r in colocation.colocation(df).collect()} == {0: (2, 2), 1: (2, 1), 2: (2, 1)}


def test_runs_of_a_null_shape_keep_a_rank(spark):
    queued = ledger(spark, (1, "QUEUED", "a", None, 1), (2, "QUEUED", "a", "S", 1), (3, "QUEUED", "a", None, 1))
    got = {r.id: r.queue_position for r in ops.fair_share_rank(queued, teams(spark, ("a", 0, 5))).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


@pytest.mark.parametrize("value", ["F.concat(F.lit('Customer#000000'), F.col('id'))", "F.col('id') * 1_000_003", "F.date_add(F.lit('2000-01-01').cast('date'), F.col('id').cast('int'))", "F.make_dt_interval(mins=F.lit(0), secs=(F.col('id') / 1000).cast('decimal(18,6)')) + F.lit('2024-01-01 05:00:00').cast('timestamp_ntz')"])
def test_ranges_are_even_whatever_the_values(spark, value):
    """Shared prefixes, sparse ids, dates and one dense hour: the largest range is near the mean."""
    rows = spark.range(40_000).select(eval(value).alias("v"), F.lit("hot").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in ordering.ranged(rows, ["g"], ["v"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 8 and max(counts) < 2 * 40_000 / 8


def test_hot_group_is_counted_range_by_range(spark):
    """A third of the rows in one shape: positions stay exact."""
    rows = spark.range(300_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 97).cast("string"))).alias("shape"),
        F.lit("QUEUED").alias("state"), F.lit("t").alias("team"), F.lit(1).alias("nodes"),
    )
    ranked = ops.fair_share_rank(rows, teams(spark, ("t", 0, 5)))
    hot = ranked.filter("shape = 'hot'").agg(F.max("queue_position").alias("n"), F.countDistinct("queue_position").alias("d")).first()
    assert hot.n == hot.d == 100_000


def test_param_query(spark):
    months = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "month_num int, revenue int")
    got = ops.param_query(spark, "SELECT :message AS value, sum(revenue) AS r FROM {m} WHERE month_num <= :cap", {"message": "hi", "cap": 3}, m=months)
    assert [tuple(r) for r in got.collect()] == [("hi", 30)]


def test_empty_team_list_means_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "team string")
    assert ops.workloads_of_teams(df, []).count() == 2
    assert ops.workloads_of_teams(df, ["a"]).count() == 1


def test_all_states_when_none(spark):
    df = ledger(spark, (1, "RUNNING", "a", "S", 1), (2, "FAILED", "a", "S", 1))
    assert ops.runs_in_state(df).count() == 2


@pytest.mark.parametrize("result,message,want", [
    ("SUCCESS", None, "success"), (None, "GPU quota", "unfinished"), ("FAILED", "exceeded its GPU quota", "quota_refused"), ("FAILED", None, "other_failed"),
])
def test_outcome_class(spark, result, message, want):
    df = spark.createDataFrame([(result, message)], "r string, m string")
    assert df.select(L.outcome_class(F.col("r"), F.col("m")).alias("o")).first().o == want


def _hold(i, node, start, end, gpus):
    return (i, node, START + dt.timedelta(minutes=start), START + dt.timedelta(minutes=end), gpus)


def _pairs(rows):
    out = {}
    for a in rows:
        others = [b for b in rows if b[0] != a[0] and b[1] == a[1] and a[2] < b[3] and b[2] < a[3]]
        out[a[0]] = (len(others), sum(bool(set(a[4] or ()) & set(b[4] or ())) for b in others))
    return out


HOLDS = "probe_id int, boot_id string, hold_start timestamp_ntz, hold_end timestamp_ntz, gpu_uuids array<string>"


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_one_node_over_many_ranges_and_batches(spark, batch):
    """A node of eight unlike GPUs has most of the rows, so the state crosses batches and ranges; null and empty sets stay."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        start = rng.randrange(200)
        gpus = [f"g{j}" for j in range(8) if rng.random() < 0.3]
        rows.append(_hold(i, rng.choice(["hot"] * 8 + ["n1", "n2", None]), start, start + rng.randint(1, 40), rng.choice([gpus, gpus, gpus, [], None])))
    df = spark.createDataFrame(rows, HOLDS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.probe_id: (r.cotenants, r.gpu_cotenants) for r in colocation.colocation(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _pairs(rows)


def test_two_rows_a_hold_are_swept(spark, monkeypatch):
    rows = [_hold(i, "n", i, i + 9, [f"g{j}" for j in range(8) if i >> j & 1]) for i in range(256)]
    seen, ranged = [], ordering.ranged
    monkeypatch.setattr(colocation.ordering, "ranged", lambda df, *a: seen.append(df.count()) or ranged(df, *a))
    got = {r.probe_id: (r.cotenants, r.gpu_cotenants) for r in colocation.colocation(spark.createDataFrame(rows, HOLDS)).collect()}
    assert seen == [512] and got == _pairs(rows)
