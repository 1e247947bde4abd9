"""Edge cases of usage, prices and attribution."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from poolsight.functions import usage as U
from poolsight.operators import usage as ops
from poolsight.sources import schemas

DAY = dt.date(2026, 7, 1)
NOON = dt.datetime(2026, 7, 1, 12)


def row(quantity=1.0, sku="SKU", compute=None, notebook=None, run_as=None, owned_by=None, created_by=None,
        job=1, tags=None, day=DAY, at=NOON, workload=None):
    return (day, at, 1, "AWS", sku, "DBU", quantity, ((compute,), (notebook,)), (run_as, owned_by, created_by),
            (job, None, workload), tags)


def usage(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.USAGE)


def prices(spark, *windows):
    return spark.createDataFrame([("SKU", "AWS", a, b, (p,)) for a, b, p in windows], schemas.LIST_PRICES)


def test_identity_precedence_and_null(spark):
    df = usage(spark, row(run_as="a", owned_by="b", created_by="c"), row(owned_by="b", created_by="c"), row(created_by="c"), row())
    assert [r.p for r in df.select(U.principal().alias("p")).collect()] == ["a", "b", "c", None]


def test_bucket_is_never_null(spark):
    df = usage(
        spark,
        row(sku="X_PROVISIONED_CAPACITY_Y", compute="ON_DEMAND_COMPUTE"),
        row(compute="RESERVED_COMPUTE"),
        row(compute="ON_DEMAND_COMPUTE", notebook="N"),
        row(notebook="N"),
        row(compute="OTHER"),
        row(),
    )
    got = [r.b for r in df.select(U.capacity_bucket().alias("b")).collect()]
    assert got == ["reserved", "reserved", "on_demand", "on_demand_notebook", "unknown", "unknown"]


def test_row_qualifies_with_either_feature(spark):
    df = usage(spark, row(compute="C"), row(notebook="N"), row())
    assert df.filter(U.is_gpu_usage()).count() == 2


@pytest.mark.parametrize("days", [0, -1, 731])
def test_lookback_bounds(days):
    with pytest.raises(ValueError):
        U.lookback(days, DAY)


def test_lookback_is_inclusive(spark):
    days = [dt.date(2026, 6, 1), dt.date(2026, 5, 31)]
    df = usage(spark, *[row(compute="C", day=d) for d in days])
    kept = df.filter(U.lookback(30, DAY)).collect()
    assert [r.usage_date for r in kept] == [dt.date(2026, 6, 1)]


def test_price_window_is_half_open_and_null_is_open(spark):
    change = dt.datetime(2026, 7, 1, 12)
    dimension = prices(spark, (dt.datetime(2026, 1, 1), change, 2.0), (change, None, 5.0))
    df = usage(spark, row(at=change), row(at=change - dt.timedelta(seconds=1)), row(at=dt.datetime(2025, 1, 1)))
    got = [r.list_price for r in ops.with_list_price(df, dimension).orderBy(F.col("usage_start_time").desc()).collect()]
    assert got == [5.0, 2.0, None]


def test_unpriced_rows_keep_units(spark):
    df = usage(spark, row(3.0, compute="C", created_by="p"), row(4.0, sku="OTHER", compute="C", created_by="p", job=2))
    dimension = prices(spark, (dt.datetime(2026, 1, 1), None, 2.0))
    (got,) = ops.usage_by_principal(df, dimension, 30, DAY).collect()
    assert (got.dbus, got.est_list_cost_usd, got.jobs) == (7.0, 6.0, 2)


def test_overlapping_prices_fan_out_and_are_reported(spark):
    dimension = prices(spark, (dt.datetime(2026, 1, 1), None, 2.0), (dt.datetime(2026, 3, 1), None, 3.0))
    (got,) = ops.usage_by_principal(usage(spark, row(1.0, compute="C", created_by="p")), dimension, 30, DAY).collect()
    assert (got.dbus, got.est_list_cost_usd, got.jobs) == (2.0, 5.0, 1)
    assert [r.price_start_time for r in ops.overlapping_prices(dimension).collect()] == [dt.datetime(2026, 3, 1)]


def test_tag_status_and_inventory(spark):
    df = usage(spark, row(compute="C", tags={"k": "v"}), row(compute="C", tags={}), row(compute="C", tags=None))
    assert [r.t for r in df.select(U.tag_status().alias("t")).collect()] == ["tagged", "untagged", "untagged"]
    assert [tuple(r) for r in ops.tag_inventory(df, 30, DAY).collect()] == [("k", "v", 1.0, 1)]


def members(spark):
    return spark.createDataFrame([("one", 0, "Ann@x"), ("two", 1, "ANN@X"), ("two", 1, "bob@x")], "team string, pos int, member string")


def test_first_team_wins_case_insensitively_and_unknown_is_kept(spark):
    people = spark.createDataFrame([("ann@X",), ("BOB@x",), ("eve",), (None,)], "principal string")
    got = {r.principal: r.team for r in ops.team_map_join(people, members(spark)).collect()}
    assert got == {"ann@X": "one", "BOB@x": "two", "eve": "unmapped", None: "unmapped"}
    assert ops.teams_of_join(people, members(spark)).count() == 3


def test_team_rollup_of_all_null_cost_is_zero(spark):
    rolled = spark.createDataFrame(
        [("ann@x", 2.0, None, 1), (None, 3.0, None, 4)], "principal string, dbus double, est_list_cost_usd double, jobs bigint"
    )
    got = {r.team: (r.dbus, r.est_list_cost_usd, r.principals, r.runs) for r in ops.usage_by_team(rolled, members(spark)).collect()}
    assert got == {"one": (2.0, 0.0, 1, 1), "unmapped": (3.0, 0.0, 0, 4)}


def test_custom_layout(spark):
    flat = U.UsageLayout(**{f: f for f in ("compute_type", "workload_type", "run_as", "owned_by", "created_by", "job_id", "pool_id", "workload_id", "tags")})
    df = spark.createDataFrame(
        [(DAY, 1, "S", "C", None, None, None, "p", 5, 2.0)],
        "usage_date date, workspace_id int, sku_name string, compute_type string, workload_type string, run_as string, "
        "owned_by string, created_by string, job_id int, usage_quantity double",
    )
    (got,) = ops.usage_daily(df, 30, DAY, flat).collect()
    assert (got.principal, got.job_id, got.workload_type, got.dbus) == ("p", 5, "C", 2.0)


def test_many_windows_equal_a_comparison_with_each(spark):
    """Overlapping, nested, empty, open and unstarted windows of several SKUs; instants at bounds; null keys."""
    rng = random.Random(2)
    at = lambda h: NOON + dt.timedelta(hours=h)
    windows = []
    for i in range(120):
        start = rng.randint(0, 60)
        sku, cloud = rng.choice([("SKU", "AWS"), ("SKU", "AWS"), ("SKU", "GCP"), (None, "AWS")])
        windows.append((sku, cloud, None if i % 30 == 0 else at(start), rng.choice([None, at(start), at(start + 1), at(start + 25), at(start - 3)]), (float(i),)))
    dimension = spark.createDataFrame(windows, schemas.LIST_PRICES)
    rows = [row(quantity=float(i), sku=rng.choice(["SKU", "SKU", "OTHER", None]), at=rng.choice([None, at(rng.randint(-5, 90)), at(rng.uniform(0, 70))])) for i in range(150)]
    got = ops.with_list_price(usage(spark, *rows), dimension, few_windows=1)
    want = ops.with_list_price(usage(spark, *rows), dimension, few_windows=1000)
    pick = lambda df: sorted(((r.usage_quantity, r.list_price) for r in df.select("usage_quantity", "list_price").collect()), key=str)
    assert got.columns == want.columns and pick(got) == pick(want) and len(pick(got)) > 500


def test_ten_thousand_windows_of_one_sku(spark):
    """Each instant is placed by order: the plan of the lookup has no comparison of times between two tables."""
    starts = [NOON + dt.timedelta(minutes=17 * i) for i in range(10_000)]
    dimension = prices(spark, *[(a, b, float(i)) for i, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True))])
    base = spark.range(60_000).select(F.expr("timestamp_ntz'2026-07-01 11:00:00' + make_dt_interval(0, 0, cast(id * 3 as int), 0)").alias("usage_start_time"), F.lit("SKU").alias("sku_name"), F.lit("AWS").alias("cloud"), "id")
    priced = ops.with_list_price(base, dimension)
    rows = priced.collect()
    assert len(rows) == 60_000
    for r in rows[:: 997]:
        i = bisect.bisect_right(starts, r.usage_start_time) - 1
        assert r.list_price == (float(i) if i >= 0 else None)
    joins = [line for line in priced._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("<" in line or ">" in line for line in joins)
