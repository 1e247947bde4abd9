"""Verdicts, registry integrity, hardware and bandwidth."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from poolsight.functions import fabric as X
from poolsight.operators import acceptance as A
from poolsight.operators import health as H


def test_drift(spark):
    df = spark.createDataFrame(
        [("pypi_egress", "CPU", True), ("pypi_egress", "CPU", False), ("cli", "CPU", False), ("root_storage_tcp443", "CPU", False),
         ("root_storage_tcp443", "GPU", False), ("cli", "CPU", None)],
        "probe string, shape string, ok boolean",
    )
    assert [r.drift for r in A.drift_classify(df).collect()] == ["CHANGED", "", "REGRESSION", "REGRESSION", "", ""]
    counts = A.verdict_counts(A.drift_classify(df)).first()
    assert (counts.passed, counts.failed, counts.skipped, counts.changed, counts.regressions) == (1, 4, 1, 1, 2)


def test_pool_ready_ignores_skipped_and_informative(spark):
    schema = "probe string, ok boolean"
    assert A.pool_ready(spark.createDataFrame([("a", True), ("b", None), ("burn_runs_terminal", False)], schema)).first().pool_ready
    assert not A.pool_ready(spark.createDataFrame([("a", True), ("b", False)], schema)).first().pool_ready
    assert A.pool_ready(spark.createDataFrame([("b", None)], schema)).first().pool_ready


def test_acceptance(spark):
    df = spark.createDataFrame(
        [(1, "PASS", "full"), (2, "PASS", "smoke"), (3, "BLOCKED", "full"), (3, "FAIL", "full")], "run int, status string, scope string"
    )
    got = {r.run: (r.verdict, r.exit_code) for r in A.acceptance_verdict(df).collect()}
    assert got == {1: ("ACCEPTED", 0), 2: ("ACCEPTED WITH CAVEATS", 0), 3: ("NOT ACCEPTED", 1)}


def registry(spark):
    return spark.createDataFrame(
        [("a", "workloads/a.example.yaml", ["OK"]), ("a", None, ["OK"]), ("b", "workloads/gone.yaml", ["OK"]), ("c", "workloads/c.yaml", ["MISSING"])],
        "id string, asset string, sentinels array<string>",
    )


def assets(spark):
    return spark.createDataFrame(
        [("workloads/a.example.yaml", "run $CODE_SOURCE_PATH/s.py"), ("workloads/a.yaml", ""), ("workloads/c.yaml", "x"),
         ("workloads/free.yaml", ""), ("workloads/x-1.yaml", ""), ("workloads/probes/p.yaml", ""), ("s.py", "print OK")],
        "path string, text string",
    )


def test_registry_integrity(spark):
    assert [tuple(r) for r in A.registry_missing_asset(registry(spark), assets(spark)).collect()] == [("b", "workloads/gone.yaml")]
    unclaimed = A.asset_unclaimed(assets(spark), registry(spark), ["workloads/x-*.yaml"])
    assert [r.path for r in unclaimed.collect()] == ["workloads/free.yaml"]
    linked = {r.id: r.found for r in A.sentinel_link(registry(spark), assets(spark)).collect()}
    assert linked == {"a": True, "c": False}
    assert [tuple(r) for r in A.duplicate_ids(registry(spark)).collect()] == [("a", 2)]


def test_drift_summary(spark):
    pending = registry(spark).withColumn("sentinels_pending", F.when(F.col("id") == "c", "soon"))
    got = A.registry_drift_summary(pending, assets(spark), ["workloads/x-*.yaml"]).first()
    assert (got.tests, got.sentinel_linked, got.missing_assets, got.missing_sentinels, got.pending) == (4, 4, 1, 0, 1)
    assert (got.unclaimed_assets, got.duplicate_ids, got.problems, got.exit_code) == (1, 1, 3, 1)


def test_glob_stays_inside_one_folder(spark):
    df = spark.createDataFrame([("w/a.yaml",), ("w/b/a.yaml",), ("w/ayaml",)], "p string")
    hits = lambda *globs: [r.p for r in df.filter(F.col("p").rlike(A.glob_pattern(globs))).collect()]
    assert hits("w/*.yaml") == ["w/a.yaml"] and hits("w/**/a.yaml") == ["w/a.yaml", "w/b/a.yaml"] and hits("**") == ["w/a.yaml", "w/b/a.yaml", "w/ayaml"]
    assert hits("w/[!b].yaml", "w/?yaml") == ["w/a.yaml", "w/ayaml"] and hits("w/[b-z].yaml") == []


def test_distinct_hardware_by_uuid(spark):
    ids = ",".join(f"g{i}" for i in range(8))
    runs = spark.createDataFrame([(1, "SUCCESS"), (2, "SUCCESS"), (3, "FAILED")], "job_run_id int, result string")
    at = dt.datetime(2026, 1, 1)
    rows = [(10, 1, at, "PASS", "8", ids), (11, 1, at, "PASS", "8", "x"), (12, 1, at, "FAIL", "8", "y"), (13, 2, at, "PASS", "8", ids)]
    receipts = spark.createDataFrame(rows, "receipt_id int, job_run_id int, logged_at timestamp_ntz, burn string, gpus_visible string, gpu_uuids string")
    one = A.distinct_hardware(runs.filter("job_run_id = 1"), receipts, 1).first()
    assert (one.success_runs, one.nodes_pass, one.distinct_nodes, one.nodes_distinct) == (1, 1, 1, True)
    got = A.distinct_hardware(runs, receipts, 2).first()
    assert (got.nodes_pass, got.distinct_nodes, got.burn_all_pass, got.nodes_distinct, got.pool_coverage) == (2, 1, True, False, False)


def test_completion_gate(spark):
    none = spark.createDataFrame([(False,)], "completed boolean")
    assert A.completion_gate(none).first().exit_code == 1
    with pytest.raises(Exception, match="no task completed"):
        A.completion_gate(none, must_complete=True).collect()


def test_fingerprint_is_order_free_and_sees_every_change(spark):
    def of(rows):
        return A.table_fingerprint(spark.createDataFrame(rows, "a int, b string"), ["a", "b"]).first()

    base = of([(1, "x"), (2, None), (2, None)])
    assert of([(2, None), (1, "x"), (2, None)]) == base
    assert of([(1, "x"), (2, None)]) != base and of([(1, "x"), (2, ""), (2, None)]) != base


def test_key_skew(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 102 + [("c",)] * 130, "k string")
    assert {r.k: r.balanced for r in A.key_skew(df, "k").collect()} == {"a": False, "b": False, "c": False}
    even = spark.createDataFrame([("a",)] * 99 + [("b",)] * 101, "k string")
    assert all(r.balanced for r in A.key_skew(even, "k").collect())


def test_gpu_health(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("g0", i, t + dt.timedelta(seconds=i), 60 + i, 300.0, 0, 5 if i < 9 else 7, 1) for i in range(11)]
    rows += [("g1", i, t + dt.timedelta(seconds=i), 60, 300.0, 4, None, 1) for i in range(11)]
    rows += [("g2", i, t + dt.timedelta(seconds=i), 60, 300.0, 0x40, 0, 1) for i in range(11)]
    df = spark.createDataFrame(rows, "gpu_uuid string, sample_id bigint, ts timestamp_ntz, temp_c bigint, power_w double, throttle bigint, ecc bigint, iters bigint")
    got = {r.gpu_uuid: r for r in H.gpu_health(df).collect()}
    assert (got["g0"].ecc_delta, got["g0"].max_temp_c, got["g0"].burn) == (2, 70, "FAIL")
    assert (got["g1"].ecc_delta, got["g1"].hw_throttle_samples, got["g1"].burn) == (-1, 0, "PASS")
    assert (got["g2"].hw_throttle_samples, got["g2"].failures) == (11, "HW throttle observed under load")
    assert got["g1"].tflops == pytest.approx(2 * 8192**3 * 11 / 10 / 1e12)


@pytest.mark.parametrize("name,ranks,size,factor", [
    ("all_reduce", 16, 1, 2 * 15 / 16), ("all_gather", 8, 8, 7 / 8), ("alltoall", 4, 4, 3 / 4), ("broadcast", 8, 1, 1.0), ("hypercube", 8, 7, 1.0), ("sendrecv", 2, 1, 1.0),
])
def test_bandwidth_factors(spark, name, ranks, size, factor):
    df = spark.createDataFrame([(name, 1_000_000_000, 1, ranks, 0.5)], "collective string, cnt bigint, type_size int, nranks int, sec double")
    got = H.bus_bandwidth(df).first()
    assert got.algbw == pytest.approx(2.0 * size) and got.busbw == pytest.approx(2.0 * size * factor)


def test_counter_delta_and_topk(spark):
    rows = [(1, d, c, p, v) for d in (0, 1) for c, p, v in (("rx_bytes", "start", 1e9), ("rx_bytes", "end", 3e9), ("new_data", "end", 5e9), ("errors", "end", 9e9))]
    df = spark.createDataFrame(rows, "run int, device int, counter string, phase string, value double")
    deltas = H.counter_delta(df)
    assert {r.counter: r.delta_gb for r in deltas.collect()} == {"rx_bytes": 4.0, "new_data": 10.0}
    assert [r.counter for r in H.topk_counters(deltas, 1).collect()] == ["new_data"]


def test_soak_drift(spark):
    df = spark.createDataFrame([(1, 1.0, 10, 1e9, 8), (1, 1.5, 10, 1e9, 8)], "run int, seconds double, iters int, bytes double, nranks int")
    got = H.soak_drift(df).first()
    assert got.drift_pct == pytest.approx(50.0) and got.sustained_busbw == pytest.approx(8.0 * 2 * 7 / 8)
    assert H.soak_drift(df, ring=True).first().sustained_busbw == pytest.approx(8.0)


def test_ranks_seen(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 1, 0)], "run int, rank int, node int")
    got = H.ranks_seen(df, 2).first()
    assert (got.ranks, got.nodes_seen, got.all_reported) == (2, "0,1", True)


def test_reduce_modes_and_bar(spark):
    df = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 3.0)], "collective string, rank int, sec double")
    got = H.reduce_modes(df, ["collective"]).first()
    assert (got.rank0, got["avg"], got["min"], got["max"], got["sum"]) == (1.0, 2.0, 1.0, 3.0, 4.0)
    bw = spark.createDataFrame([("a", 10.0), ("b", 30.0)], "n string, busbw double")
    assert {r.n: r.meets_bar for r in H.bench_peak(bw, ["n"], 20).collect()} == {"a": False, "b": True}


def test_throttle_mask_bits(spark):
    df = spark.range(256).select(F.col("id").alias("throttle"))
    got = df.filter(X.hardware_throttled(F.col("throttle"))).count()
    assert got == sum(1 for b in range(256) if b & 0xC8)


def test_fingerprints_of_cells_that_read_alike_differ(spark):
    def print_of(*row):
        return A.table_fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().fingerprint

    rows = [(None, "x"), ("<null>", "x"), ("-", "x"), ("", "x"), ("x", None), ("a\u0001", "b"), ("a", "\u0001b"), ("1:a", ""), ("", "1:a"), ("a1:b", ""), ("a", "b")]
    assert len({print_of(*row) for row in rows}) == len(rows)


def test_trees_find_the_ranges_and_only_these_are_read(spark):
    rows = spark.range(100_000).select("id", (F.col("id") % 7).alias("v"))
    path = A.workspace.fresh_path(spark, "keyed")
    rows.write.parquet(path)
    before = spark.read.parquet(path)
    assert A.differing_ranges(*[A.fingerprint_tree(before, ["id", "v"], "id", 0, 99_999)] * 2, 0, 99_999) == []
    after = before.withColumn("v", F.when(F.col("id") == 31_000, 9).otherwise(F.col("v"))).filter("id <> 70123")
    extra = spark.createDataFrame([(5, 5), (None, 1), (200_000, 1), (200_000, 1)], "id long, v long")
    trees = [A.fingerprint_tree(df, ["id", "v"], "id", 0, 99_999) for df in (before, after.unionByName(extra))]
    ranges = A.differing_ranges(*trees, 0, 99_999)
    assert len(ranges) == 4 and (None, None) in ranges and all(e - s < 25 for s, e in ranges if s is not None)
    diff = A.changed_rows(before, after.unionByName(extra), ["id", "v"], "id", 0, 99_999)
    assert {(r["key"], r["before"], r["after"]) for r in diff.collect()} == {(31_000, 1, 1), (70_123, 1, 0), (5, 0, 1), (None, 0, 1), (200_000, 0, 2)}
    scans = [line for line in diff._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line]
    assert scans and not any("PushedFilters: []" in line for line in scans)


def test_differences_in_thousands_of_separate_ranges(spark):
    before = spark.range(40_960).select("id", (F.col("id") % 7).alias("v"))
    after = before.withColumn("v", F.when(F.col("id") % 20 == 3, 9).otherwise(F.col("v")))
    extra = spark.createDataFrame([(None, 1), (-7, 1), (50_000, 1)], "id long, v long")
    got = A.changed_rows(before, after.unionByName(extra), ["id", "v"], "id", 0, 40_959).collect()
    want = {(k, 1, 1) for k in range(3, 40_960, 20)} | {(None, 0, 1), (-7, 0, 1), (50_000, 0, 1)}
    assert len(got) == len(want) and {(r["key"], r["before"], r["after"]) for r in got} == want


def test_registry_checks_send_no_side_to_the_driver(spark):
    """Tables of few bytes on disk and many rows are joined by sorting, whatever the threshold of broadcasts."""
    path = A.workspace.fresh_path(spark, "registry")
    spark.range(1_000).selectExpr("concat('t', id) AS id", "concat('workloads/w', id, '.yaml') AS asset", "array('s') AS sentinels", "CAST(NULL AS STRING) AS sentinels_pending").write.parquet(path)
    registry = spark.read.parquet(path)
    files = registry.selectExpr("asset AS path", "'s' AS text")
    joins = [A.registry_missing_asset(registry, files), A.asset_unclaimed(files, registry, []), A.sentinel_link(registry, files), A.registry_drift_summary(registry, files, [])]
    for df in joins:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert joins[-1].first().asDict() == {
        "tests": 1_000, "sentinel_linked": 1_000, "missing_assets": 0, "missing_sentinels": 0, "pending": 0, "unclaimed_assets": 0,
        "duplicate_ids": 0, "problems": 0, "exit_code": 0,
    }
