"""Plan checks: pushdown, pruning, join kinds and what is left without broadcasting."""

import pytest

import __spark_entry__ as entry_point
from pyspark.sql import functions as F

from poolsight.plans import bindings as B
from poolsight.plans.registry import REGISTRY
from poolsight.sources import schemas

ROOT = "/root/testdata/sf0.001"
def plan(spark, name):
    return entry_point.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()


def test_chargeback_prunes_and_pushes(spark):
    text = plan(spark, "usage_by_principal")
    line_scan = next(x for x in text.splitlines() if "FileScan" in x and "l_shipdate" in x)
    assert "GreaterThanOrEqual(l_shipdate" in line_scan and "l_extendedprice" not in line_scan


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "limit_active")
    assert "TakeOrderedAndProject" in plan(spark, "failure_feed")


def test_rank_filters_prune_before_the_shuffle(spark):
    for name in ("loss_convergence", "topk_counters"):
        assert "WindowGroupLimit" in plan(spark, name)


# One text per manifest or node: a sort there is cheap.
SORTED_AGGREGATES = {"catalog_shadow", "correlation_ids"}
# These write or stream before they return, so their plan is the read at the end.
WRITERS = ("scan_manifest_files", "stream_", "write_", "tuned_", "ts_prior", "otel_sink", "scan_otel", "scan_catalog", "scan_log")


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY.queries if not n.startswith(WRITERS)))
def test_plans_stay_in_the_hash_path_and_read_few_times(spark, name):
    text = plan(spark, name)
    assert name in SORTED_AGGREGATES or "SortAggregate" not in text
    # the archive and the file-like tables of the registry are unions, read once per kind of row
    assert text.count("FileScan") <= 8 or name in ("asset_unclaimed", "sentinel_link", "registry_drift_summary", "run_archive_copy")


def test_one_ledger_aggregate_serves_shapes_and_teams(spark):
    assert plan(spark, "fits_now").count("FileScan") <= 5


def test_bindings_cover_whole_tables(spark):
    orders = B.table(spark, ROOT, "orders").count()
    assert B.runs(spark, ROOT).count() == orders and B.job_runs(spark, ROOT).count() == orders
    events = B.table(spark, ROOT, "events").count()
    for build in (B.run_polls, B.otel_logs, B.gpu_samples, B.probes, B.loss_curve, B.check_results, B.log_lines):
        assert build(spark, ROOT).agg(F.count(F.lit(1))).first()[0] == events


@pytest.mark.parametrize("build,declared", [(B.usage, schemas.USAGE), (B.list_prices, schemas.LIST_PRICES), (B.timeline, schemas.JOB_RUN_TIMELINE)])
def test_bindings_have_the_declared_types(spark, build, declared):
    want = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], declared).schema}
    assert dict(build(spark, ROOT).dtypes) == want
